"""Table routing of P8I rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Exact-case sub-source names per target table.
TRACKING_SOURCES = ("Redicent", "Efficnt", "Esmcnt", "Eoircnt", "Ardrcnt")
ESM_SOURCES = ("Esm_emit beams", "Esm emitters")
TRACKING_TABLE = "p8i_tracking.tracking_data"
ESM_TABLE = "p8i_esm.esm_data"
# -----------------------------------------------------------------------------


def route_p8i(df: DataFrame, col: str = "sub_source_name") -> DataFrame:
    """C13, adopted per row (X17): ``target_table`` for known names, else
    ``route_error`` ("Missing 'sub_source_name' in row." / "Unknown
    sub_source: <name>")."""
    name = F.col(col)
    missing = name.isNull() | (name == "")
    target = (F.when(missing, F.lit(None).cast("string"))
              .when(name.isin(*TRACKING_SOURCES), F.lit(TRACKING_TABLE))
              .when(name.isin(*ESM_SOURCES), F.lit(ESM_TABLE)))
    error = (F.when(missing, F.lit("Missing 'sub_source_name' in row."))
             .when(target.isNull(), F.concat(F.lit("Unknown sub_source: "), name)))
    return df.withColumn("target_table", target).withColumn("route_error", error)
