"""Time the join-sum queries; one JSON line. $BENCH_SF_DIR and $BENCH_CPUS choose data and cores.

Each query runs once to warm up (code generation, file listing) and then three times; its median
counts. ``plain`` is the same query as SQL text over the same views, the baseline to beat.
"""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from sumweave.plans import suite
from sumweave.plans.parser import parse_query
from sumweave.sources.tables import RELATIONS, catalog

HEADLINE = ["join2", "join3", "join5", "cycle", "cycle3", "composite", "multi_filter", "trans_dedupe", "m2m", "sum_wrap"]


def timed(make) -> float:
    took = []
    for _ in range(4):
        began = time.perf_counter()
        make().collect()
        took.append(time.perf_counter() - began)
    return median(took[1:])


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cat = catalog(spark, d)
    for rid in RELATIONS:
        cat.relation(rid).createOrReplaceTempView(f"r{rid}")
    wide = lambda x: f"NULLIF(SUM(CAST({x} AS DECIMAL(38,0))), 0)"
    queries, plain = {}, {}
    for name in HEADLINE:
        q = parse_query(suite.QUERIES[name])
        queries[name] = round(timed(lambda n=name: suite.run(spark, d, n)), 4)
        sql = q.to_sql("spark", total=wide if name in suite.WIDE else None)
        plain[name] = round(timed(lambda s=sql: spark.sql(s)), 4)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(queries.values()), 4), "unit": "sec", "queries": queries, "plain": plain, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
