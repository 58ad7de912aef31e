"""Writers for the record tables, rejects, summaries and exports."""
