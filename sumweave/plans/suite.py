"""The registered join-sum queries over the star-schema relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumweave.functions.u64 import MOD, signed
from sumweave.operators.relational import partition_by, partition_sizes, project
from sumweave.plans.builder import build
from sumweave.plans.parser import parse_query
from sumweave.sources import colbin
from sumweave.sources.catalog import SAMPLE_ROWS
from sumweave.sources.shared import fresh
from sumweave.sources.tables import RELATIONS, catalog, duckdb_ctes, select_list
from sumweave.streaming.protocol import run_protocol

QUERIES = {
    "join2": "6 5|0.0=1.0|0.4 1.2",
    "filter_gt": "6 5|0.0=1.0&1.2>30000000|0.5 1.0",
    "filter_lt": "5 2|0.1=1.0&0.3<9800|0.2",
    "filter_eq": "6 4|0.1=1.0&0.3=1|1.2 0.5",
    "multi_filter": "6 5|0.0=1.0&0.4>10&0.4<40&0.3=2|0.5",
    "join3": "6 5 2|0.0=1.0&1.1=2.0&2.0>700|0.1 2.0 0.5",
    "join5": "6 5 2 1 0|0.0=1.0&1.1=2.0&2.1=3.0&3.1=4.0&4.0>1|0.5 2.2 4.0",
    "cycle": "6 5 2 3|0.0=1.0&1.1=2.0&0.2=3.0&2.1=3.1|0.5 3.0",
    "intra_late": "6 4|0.1=1.0&0.3=0.4|0.5",
    "intra_first": "6 4|0.3=0.4&0.1=1.0|0.5",
    "self_binding": "1 1|0.1=1.1|0.0 1.0",
    "deferred": "6 5 2 1|0.0=1.0&2.1=3.0&1.1=2.0|0.5 3.1",
    "dedupe": "5 2|0.1=1.0|0.1 1.0 0.1 0.2 1.0",
    "trans_dedupe": "5 2 7|0.1=1.0&1.0=2.1|0.1 1.0 2.1",
    "empty": "5 2|0.1=1.0&1.0>999999999|0.2 1.0",
    "zero_sum": "1 0|0.1=1.0&1.0=0|1.0 0.0",
    "unsigned_gt": "2 1|0.1=1.0&0.2>500000|0.0 0.2",
    "unsigned_lt": "2 1|0.1=1.0&0.2<500000|0.0 0.2",
    "wide64": "7 2|0.1=1.0&0.2>1706500000000000|0.2 0.3",
    "m2m": "2 3|0.1=1.1|0.0 1.0",
    "composite": "6 6|0.0=1.0&0.3=1.3|0.5 1.4",
    "cycle3": "6 3 2|0.2=1.0&2.1=1.1&0.1=2.0|0.5 2.0",
    "single": "6|0.4>10|0.5",
    "cross": "1 0 3|0.1=1.0|2.0 0.0",
    "disconnected": "1 0 3 1|0.1=1.0&2.1=3.0|2.0 0.0",
    "sum_big": "7 2|0.1=1.0|0.2",
    "sum_wrap": "7 7|0.1=1.1|0.2",
}
#: Sums beyond 2**63: returned as DECIMAL(20,0).
WIDE = {"sum_big", "sum_wrap"}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = parse_query(QUERIES[name])
    return build(catalog(spark, sf_dir, q.relations), q, "u64" if name in WIDE else "bigint")


def sql(name: str) -> str:
    q = parse_query(QUERIES[name])
    wide = lambda x: f"CAST(NULLIF(((SUM({x}::HUGEINT) % {MOD}::HUGEINT) + {MOD}::HUGEINT) % {MOD}::HUGEINT, 0) AS DECIMAL(20,0))"
    return f"{duckdb_ctes(q.relations)} {q.to_sql('duckdb', total=wide if name in WIDE else None)}"


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rows, distinct count, min and max of every column of every relation."""
    cat = catalog(spark, sf_dir)
    out = None
    for rid in RELATIONS:
        s = cat.statistics(rid, exact=True)
        out = s if out is None else out.unionByName(s)
    return out


def column_stats_sql() -> str:
    u = lambda x: f"CAST(CASE WHEN {x} < 0 THEN {x}::HUGEINT + {MOD}::HUGEINT ELSE {x}::HUGEINT END AS DECIMAL(20,0))"
    parts = [
        f"SELECT {rid}::INTEGER AS relation, {i}::INTEGER AS col, COUNT(*) AS n_rows, COUNT(DISTINCT c{i}) AS n_distinct, MIN({u(f'c{i}')}) AS min_value, MAX({u(f'c{i}')}) AS max_value FROM r{rid}"
        for rid, (_, cols) in RELATIONS.items()
        for i in range(len(cols))
    ]
    return f"{duckdb_ctes(RELATIONS)} " + " UNION ALL ".join(parts)


def relation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of relation r3 as it is registered: scan and positional projection."""
    return project(catalog(spark, sf_dir, [3]).relation(3), [2, 0])


def relation_scan_sql() -> str:
    return f"SELECT c2, c0 FROM (SELECT {select_list(3, 'duckdb')} FROM supplier)"


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of r2 by position, one of them twice."""
    return project(catalog(spark, sf_dir, [2]).relation(2), [2, 0, 2])


def projection_sql() -> str:
    return f"SELECT c2, c0, c2 AS c2_1 FROM (SELECT {select_list(2, 'duckdb')} FROM customer)"


def column_files(spark: SparkSession, sf_dir: str, relation: int) -> str:
    """A relation as binary column files in the shared folder; returns their path."""
    path = fresh(spark, f"r{relation}")
    colbin.write(catalog(spark, sf_dir, [relation]).relation(relation), path)
    return path


def colbin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation r5 written to binary column files and read back."""
    return colbin.read(spark, column_files(spark, sf_dir, 5))


def colbin_scan_sql() -> str:
    return f"SELECT {select_list(5, 'duckdb')} FROM orders"


#: Queries of the protocol entry, over column files of r1, r2 and r3 in this load order.
LINES = ("0 1|0.0=1.1|0.0 1.0", "1 2|0.1=1.1&0.2<500000|0.0 1.0", "0|0.0<0|0.1")


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line protocol over column files: each query's number and answer line."""
    files = [column_files(spark, sf_dir, r) for r in (1, 2, 3)]
    out = list(run_protocol(spark, [*files, "Done", *LINES[:2], "F", LINES[2], "F"]))
    return spark.createDataFrame(list(enumerate(out)), "query int, answer string")


def protocol_sql() -> str:
    parts = []
    for i, line in enumerate(LINES):
        q = parse_query(line)
        inner = q.to_sql("duckdb", prefix="f", total=lambda x: f"coalesce(CAST(NULLIF(((SUM({x}::HUGEINT) % {MOD}::HUGEINT) + {MOD}::HUGEINT) % {MOD}::HUGEINT, 0) AS VARCHAR), 'NULL')")
        parts.append(f"SELECT {i}::INTEGER AS query, " + " || ' ' || ".join(f"s{k}" for k in range(len(q.output_map()))) + f" AS answer FROM ({inner})")
    views = ", ".join(f"f{k} AS (SELECT * FROM r{r})" for k, r in enumerate((1, 2, 3)))
    return f"{duckdb_ctes((1, 2, 3))}, {views} " + " UNION ALL ".join(parts)


def sql_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL text of a query over the views r0, r1, ... that a catalog registers."""
    q = parse_query(QUERIES["join5"])
    catalog(spark, sf_dir, q.relations, views=True)
    return spark.sql(q.to_sql("spark"))


def row_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of r2 by their place in the order of c0, as BIGINT bits."""
    cat = catalog(spark, sf_dir, [2])
    rows = [(i, *map(signed, cat.row_at(2, i, "c0"))) for i in (0, 7, 100)]
    return spark.createDataFrame(rows, "place long, c0 long, c1 long, c2 long")


def row_at_sql() -> str:
    return f"SELECT * FROM (SELECT row_number() OVER (ORDER BY c0) - 1 AS place, c0, c1, c2 FROM (SELECT {select_list(2, 'duckdb')} FROM customer)) WHERE place IN (0, 7, 100)"


def sampled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of r5's columns among every k-th row."""
    return catalog(spark, sf_dir, [5]).sampled_distinct(5, "c0")


def sampled_stats_sql() -> str:
    counts = ", ".join(f"count(DISTINCT c{i}) AS c{i}" for i in range(len(RELATIONS[5][1])))
    return f"{duckdb_ctes([5])} SELECT {counts} FROM r5 WHERE c0 % (SELECT greatest(1, count(*) // {SAMPLE_ROWS}) FROM r5) = 0"


def partitioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r5 dealt by c1: rows and keys over all partitions (a key in two of them would count twice)."""
    sizes = partition_sizes(partition_by(catalog(spark, sf_dir, [5]).relation(5), "c1", 16), ["c1"])
    return sizes.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"))


def partitioning_sql() -> str:
    return f"{duckdb_ctes([5])} SELECT count(*) AS n_rows, count(DISTINCT c1) AS n_keys FROM r5"


#: Entries beside the queries: name -> (DataFrame, SQL).
MORE = {
    "column_stats": (column_stats, column_stats_sql),
    "relation_scan": (relation_scan, relation_scan_sql),
    "projection": (projection, projection_sql),
    "colbin_scan": (colbin_scan, colbin_scan_sql),
    "protocol": (protocol, protocol_sql),
    "sql_form": (sql_form, lambda: sql("join5")),
    "row_at": (row_at, row_at_sql),
    "partitioning": (partitioning, partitioning_sql),
    "sampled_stats": (sampled_stats, sampled_stats_sql),
}
