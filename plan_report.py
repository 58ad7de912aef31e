"""Write a Markdown summary of the executed physical plan of every
registered query: joins, exchanges, aggregates, Python operators and the
columns read from each scan. ``python plan_report.py [sf_dir] > PLANS.md``"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans.registry import QUERIES  # noqa: E402
from tidewater.session import local_session  # noqa: E402

OPS = (r"BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
       r"Exchange RoundRobinPartitioning|Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|"
       r"ReusedExchange|HashAggregate|ObjectHashAggregate|SortAggregate|Window|CollectMetrics|"
       r"Generate|ArrowEvalPython|BatchEvalPython|MapInPandas|TakeOrderedAndProject")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    print("# Physical plans of the registered queries\n")
    print(f"Executed (AQE final) plans at `{os.path.basename(sf.rstrip('/'))}`. Counts of operators per query;")
    print("`RoundRobinPartitioning` is the spread of single-split test tables (absent for big inputs).\n")
    print("| query | operators | columns read per scan |")
    print("|---|---|---|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = Counter(re.findall(OPS, plan))
        scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
        cols = "; ".join(sorted({re.sub(r"#\d+L?", "", x) for x in scans}))
        opstr = ", ".join(f"{k} x{v}" for k, v in sorted(ops.items()))
        print(f"| {name} | {opstr} | {cols} |")
    spark.stop()


if __name__ == "__main__":
    main()
