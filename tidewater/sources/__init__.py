"""Readers: driver tables and feed derivations (feeds), files (files)."""
