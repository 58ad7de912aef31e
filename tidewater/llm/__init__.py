"""Operators for large text corpora used as training data.

Nothing else in the library imports this subpackage.  Its queries are in
``tidewater.llm.queries``; each operator has a module of its own.
"""
