"""The SQL refinement step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sinks.writers import write_csv

REFINE_SQL = "SELECT latitude, longitude, speed FROM {cdf_data_view} WHERE speed > :threshold"


def refine_with_sql(records: DataFrame, threshold: float = 10.0, out_csv: str | None = None) -> DataFrame:
    """C1 as SQL text over the records: the DataFrame is bound as a view for
    this statement only, the threshold is a named parameter (no string
    building), and the optional CSV is written by the executors (B3), not
    through the driver. Missing speeds are NULL, so they never pass
    ``speed > threshold`` (X8)."""
    result = records.sparkSession.sql(REFINE_SQL, args={"threshold": float(threshold)}, cdf_data_view=records)
    if out_csv:
        write_csv(result, out_csv)
    return result
