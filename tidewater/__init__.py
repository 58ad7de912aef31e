"""tidewater: maritime feed ingest and query jobs on Spark DataFrames.

Sub-packages:
  functions  -- Column expressions (timestamps, coordinates, text, record ids)
  sources    -- readers for files and for the driver tables / feed derivations
  operators  -- feed converters, reject split, routing, joins, checks, catalogue, media
  sinks      -- table and file writers
  plans      -- the registered queries and their DuckDB oracle SQL
  streaming  -- incremental file ingest with Structured Streaming
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "sources", "operators", "sinks", "plans", "streaming"]
