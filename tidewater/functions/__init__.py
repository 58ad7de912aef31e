"""Column expressions shared by every job."""

from . import coords, records, text, timestamps  # noqa: F401
