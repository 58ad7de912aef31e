"""Record-level Column expressions: ids (J27), NaN clean-up (J5), JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col_


def stable_uuid(*parts) -> Column:
    """A UUID-shaped id from the md5 of the parts joined by ':'.

    Deterministic, so a retried task or a replayed stream batch produces the
    same ids (``uuid()`` would differ per execution).
    """
    h = F.md5(F.concat_ws(":", *[col_(p).cast("string") for p in parts]))
    for at in (9, 14, 19, 24):
        h = F.overlay(h, F.lit("-"), at, 0)
    return h


def nan_to_null(c) -> Column:
    """J5 for one DOUBLE column."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def row_json(df, columns=None) -> Column:
    """The row as JSON text, NULL fields kept as ``null``; NaN doubles are
    written as null (J5) because JSON has no NaN."""
    cols = columns or df.columns
    fields = []
    for name in cols:
        dtype = df.schema[name].dataType.typeName()
        c = F.col(f"`{name}`")
        fields.append((nan_to_null(c) if dtype in ("double", "float") else c).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


#: Text that counts as a number in a raw cell.
PLAIN_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def raw_fields(records: DataFrame, keep=("feed",), raw_col: str = "raw_data") -> DataFrame:
    """The fields of each raw row, a row for each: the columns to
    ``keep``, key, kind ('null', 'object', 'array' or 'scalar') and value as text.

    The text is parsed once, into a VARIANT, whatever fields it has. Text that
    is no JSON, a JSON value that is no object and an object without
    fields give one row without key, so that no raw row is lost; no text, none."""
    cols = ", ".join(f"`{c}`" for c in keep)
    text = F.col(raw_col)
    parsed = records.where(text.isNotNull()).select(*keep, text.startswith("{").alias("_brace"), F.try_parse_json(raw_col).alias("_raw"))
    # a schema is built from every field of a value: only where the first character leaves the type open
    is_object = F.col("_brace") | F.schema_of_variant("_raw").startswith("OBJECT")
    parsed = parsed.withColumn("_raw", F.when(is_object, F.col("_raw")))
    fields = records.sparkSession.sql(
        f"select {cols}, f.key as key, f.value as _value, is_variant_null(f.value) as _null, try_variant_get(f.value, '$', 'string') as value "
        "from {parsed}, lateral variant_explode_outer(_raw) f", parsed=parsed)

    def is_a(kind, mark):
        return F.col("value").startswith(mark) & F.schema_of_variant("_value").startswith(kind)

    kind = (F.when(F.col("key").isNull(), None).when(F.col("_null"), "null").when(is_a("OBJECT", "{"), "object")
            .when(is_a("ARRAY", "["), "array").otherwise("scalar"))
    return fields.select(*keep, "key", kind.alias("kind"), "value")


def field_profile(fields: DataFrame, by=("feed",)) -> DataFrame:
    """Counts and number ranges of each field. Fixed-width aggregates, so the
    rows are folded in hash tables before the shuffle."""
    scalar = F.col("kind") == "scalar"
    number = F.when(scalar & F.col("value").rlike(PLAIN_NUMBER), F.col("value").try_cast("double"))
    return fields.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "null").alias("n_null"),
        F.count_if(F.col("kind") == "object").alias("n_object"), F.sum(F.when(scalar, F.length("value"))).alias("n_chars"),
        F.count(number).alias("n_numbers"), F.min(number).alias("least"), F.max(number).alias("greatest"))
