"""The record table of the registered queries, written in rounds."""

import os

import pytest
from pyspark.sql import functions as F

from tidewater.plans import registry
from tidewater.sinks import store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_rounds_hold_every_record_once(spark, tmp_path):
    whole = registry.all_records(spark, SF)
    rounds = list(registry.record_rounds(spark, SF, most_rows=5000))
    assert 3 <= len(rounds) <= 5 and all(r.schema.simpleString() == whole.schema.simpleString() for r in rounds)
    path = str(tmp_path / "records")
    store.write_clustered_rounds(rounds, path)
    got, want = spark.read.parquet(path), registry.stored_records(spark, SF)
    assert got.dtypes == want.dtypes
    sums = [F.count("*"), *(F.sum(F.xxhash64(F.col(f"`{c}`").cast("string")).cast("decimal(30,0)")) for c in want.columns)]
    assert got.agg(*sums).collect() == want.agg(*sums).collect()
    row = F.sum(F.xxhash64(*want.columns).cast("decimal(30,0)"))
    assert got.agg(row).collect() == want.agg(row).collect() and got.count() == whole.count()


def test_a_small_table_is_one_round(spark):
    (only,) = registry.record_rounds(spark, SF)
    assert only is registry.all_records(spark, SF)
