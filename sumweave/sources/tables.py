"""Relations r0..r7 over the star-schema tables; each column is a BIGINT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumweave.functions import u64
from sumweave.sources.catalog import Catalog

#: relation id -> (table, its columns: a name, or (kind, name))
RELATIONS = {
    0: ("region", ["r_regionkey"]),
    1: ("nation", ["n_nationkey", "n_regionkey"]),
    2: ("customer", ["c_custkey", "c_nationkey", ("cents", "c_acctbal")]),
    3: ("supplier", ["s_suppkey", "s_nationkey", ("cents", "s_acctbal")]),
    4: ("part", ["p_partkey", "p_size", ("cents", "p_retailprice")]),
    5: ("orders", ["o_orderkey", "o_custkey", ("cents", "o_totalprice"), ("day", "o_orderdate")]),
    6: ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", ("cents", "l_extendedprice"), ("cents", "l_discount"), ("cents", "l_tax"), ("day", "l_shipdate")]),
    7: ("events", ["event_id", "user_id", ("us", "ts"), ("cents", "value")]),
}

_FORMS = {
    "spark": {"cents": "CAST(ROUND({} * 100) AS BIGINT)", "day": "CAST(unix_date(CAST({} AS DATE)) AS BIGINT)", "us": "unix_micros(CAST({} AS TIMESTAMP))"},
    "duckdb": {"cents": "CAST(ROUND({} * 100) AS BIGINT)", "day": "CAST(date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) AS BIGINT)", "us": "CAST(epoch_us({}) AS BIGINT)"},
}


def _form(dialect: str, c) -> str:
    return f"CAST({c} AS BIGINT)" if isinstance(c, str) else _FORMS[dialect][c[0]].format(c[1])


def select_list(rid: int, dialect: str) -> str:
    return ", ".join(f"{_form(dialect, c)} AS c{i}" for i, c in enumerate(RELATIONS[rid][1]))


#: relation id -> its keys (sets of columns no two rows agree in)
KEYS = {0: [[0]], 1: [[0]], 2: [[0]], 3: [[0]], 4: [[0]], 5: [[0]], 6: [[0, 3]], 7: [[0]]}


def _bounds(c, low: int | None, high: int | None) -> str:
    """A condition on the stored column that every row whose value is within the bounds meets."""
    kind, name = ("whole", c) if isinstance(c, str) else c
    least, most = {
        "whole": (lambda v: f"{name} > {v - 1}", lambda v: f"{name} < {v + 1}"),
        "cents": (lambda v: f"{name} > {(v - 1) / 100!r}D", lambda v: f"{name} < {(v + 1) / 100!r}D"),
        "day": (lambda v: f"{name} >= CAST(date_from_unix_date({v}) AS TIMESTAMP)", lambda v: f"{name} < CAST(date_from_unix_date({v + 1}) AS TIMESTAMP)"),
        "us": (lambda v: f"{name} >= timestamp_micros({v})", lambda v: f"{name} <= timestamp_micros({v})"),
    }[kind]
    return " AND ".join([*([least(low)] if low is not None else []), *([most(high)] if high is not None else [])]) or "true"


#: Bounds beyond this are left to the filter itself (dates end before).
FAR = {"day": 1_000_000, "us": 1 << 55, "cents": 1 << 50, "whole": 1 << 50}


def _implied(c, op: str, constant: int) -> str | None:
    kind = "whole" if isinstance(c, str) else c[0]
    spans = u64.ranges(op, constant)
    if any(v is not None and abs(v) > FAR[kind] for span in spans for v in span):
        return None
    return " OR ".join(f"({_bounds(c, *span)})" for span in spans)


#: (application, path, columns) -> (what was listed there, the table, its columns as c0, c1, ...)
_OPEN: dict[tuple[str, str, tuple], tuple[tuple, DataFrame, DataFrame]] = {}


def _listed(spark: SparkSession, path: str) -> tuple:
    """Length and time of a table's file or folder (a folder's time is that of its last change of files)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return status.getLen(), status.getModificationTime()


def opened(spark: SparkSession, path: str, exprs: tuple[str, ...] = ("*",)) -> tuple[DataFrame, DataFrame]:
    """A table and a selection from it; it is opened anew where its files have changed."""
    key, now = (spark.sparkContext.applicationId, path, exprs), _listed(spark, path)
    if key not in _OPEN or _OPEN[key][0] != now:
        df = spark.read.parquet(path)
        _OPEN[key] = now, df, df.selectExpr(*exprs)
    return _OPEN[key][1:]


def catalog(spark: SparkSession, sf_dir: str, relations=None, views: bool = False) -> Catalog:
    """A catalog over ``sf_dir``; only the wanted relations are opened."""
    cat = Catalog(spark, views)
    for rid in RELATIONS if relations is None else sorted(set(relations)):
        table, columns = RELATIONS[rid]
        exprs = tuple(f"{_form('spark', c)} AS c{i}" for i, c in enumerate(columns))
        df, relation = opened(spark, f"{sf_dir}/{table}.parquet", exprs)

        def narrowed(filters, df=df, columns=columns, exprs=exprs):
            implied = [x for f in filters if (x := _implied(columns[f.col.column], f.op, f.constant))]
            return df.where(" AND ".join(f"({x})" for x in implied) or "true").selectExpr(*exprs)

        cat.add(relation, rid, KEYS[rid], narrowed, len(columns))
    return cat


def duckdb_ctes(relations) -> str:
    """WITH clauses that define r<id> for DuckDB over the tables' views."""
    return "WITH " + ", ".join(f"r{r} AS (SELECT {select_list(r, 'duckdb')} FROM {RELATIONS[r][0]})" for r in sorted(set(relations)))
