"""Registered queries (registry) and their DuckDB oracle SQL (oracle)."""
