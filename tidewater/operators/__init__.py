"""Operators: converters, routing, joins, checks, catalogue and media jobs."""
