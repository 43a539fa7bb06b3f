"""The engine's operators, each a thin declaration over DataFrames.

Columns of FROM entry ``i`` are named ``b{i}_c{j}``, so one relation can stand under several
bindings without ambiguous attributes. Nothing here picks a physical strategy: Catalyst prunes
columns, pushes filters to the scan and chooses the join by size; AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.functions import u64
from sumweave.plans.model import Col, Filter, JoinPred


def scan(relation: DataFrame, binding: int, width: int | None = None) -> DataFrame:
    """All columns of a relation under a binding."""
    return relation.toDF(*[Col(binding, i).name for i in range(len(relation.columns) if width is None else width)])


def project(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position; order is free and repeats are allowed (later ones get a suffix)."""
    seen: dict[str, int] = {}
    out = []
    for p in positions:
        name = df.columns[p]
        seen[name] = seen.get(name, -1) + 1
        out.append(F.col(f"`{name}`").alias(name if not seen[name] else f"{name}_{seen[name]}"))
    return df.select(out)


def filter_constant(df: DataFrame, f: Filter, non_negative: bool = False) -> DataFrame:
    """Rows whose column stands in unsigned order to a constant."""
    return df.where(u64.compare(F.col(f.col.name), f.op, f.constant, non_negative))


def filter_equal(df: DataFrame, left: Col, right: Col) -> DataFrame:
    """Rows in which two columns are equal (closes cycles; intra-relation predicates)."""
    return df.where(F.col(left.name) == F.col(right.name))


def equi_join(left: DataFrame, right: DataFrame, on: Iterable[JoinPred]) -> DataFrame:
    """Inner join on all given column pairs at once (one shuffle for a composite key)."""
    cond = " AND ".join(f"{p.left.name} = {p.right.name}" for p in on)
    return left.join(right, F.expr(cond), "inner") if cond else left.crossJoin(right)


def partition_by(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Hash partitions on a key, for several joins on the same key in a row."""
    return df.repartition(partitions, column) if partitions else df.repartition(column)


def partition_sizes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Diagnostics: each partition that has rows, its rows, and its distinct keys if columns are given."""
    more = [F.count_distinct(*keys).alias("n_keys")] if keys else []
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_rows"), *more)


#: Name of a side's row count beside its key columns and partial sums.
COUNT = "n_rows"


def _sums(columns: Sequence[str]) -> tuple[list, dict[str, str]]:
    """Aggregates of the columns' pieces, and SQL that puts each column's sum together."""
    aggs, totals = [], {}
    for i, c in enumerate(columns):
        names = [f"_{i}_{k}" for k in range(len(u64.sum_pieces(c)))]
        aggs += [f"{x} AS {n}" for x, n in zip(u64.sum_pieces(c), names, strict=True)]
        totals[c] = u64.value_from_pieces(names)
    return aggs, totals


def weigh(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each combination of ``keys``: the keys, how many rows have it (``n_rows``) and the
    columns' sums ``sum_<column>``, all DECIMAL(20,0) mod 2**64. Without keys one row, of zeros for no rows."""
    aggs, totals = _sums(columns)
    aggs.append(f"count(1) AS {COUNT}")
    out = df.groupBy(*keys).agg(*map(F.expr, aggs)) if keys else df.selectExpr(*aggs)
    sums = [f"coalesce({t}, CAST(0 AS DECIMAL(20,0))) AS sum_{c}" for c, t in totals.items()]
    return out.selectExpr(*keys, f"CAST({COUNT} AS DECIMAL(20,0)) AS {COUNT}", *sums)


def fold(side: DataFrame, other: DataFrame, on: Iterable[JoinPred], keys: Sequence[str]) -> DataFrame:
    """The weighed join of two weighed sides, without its rows: counts multiply, each side's sums are
    multiplied by the other's count, and what has the same ``keys`` is added up."""
    sums = [[c for c in df.columns if c.startswith("sum_")] for df in (side, other)]
    joined = equi_join(side.withColumnRenamed(COUNT, "_a"), other.withColumnRenamed(COUNT, "_b"), on)
    outs = [(COUNT, u64.product("_a", "_b")), *((c, u64.product(c, "_b")) for c in sums[0]), *((c, u64.product(c, "_a")) for c in sums[1])]
    rows = joined.selectExpr(*keys, *[f"{x} AS {n}" for n, x in outs])
    total = rows.groupBy(*keys).agg(*[F.expr(f"sum({n}) AS {n}") for n, _ in outs])
    return total.selectExpr(*keys, *[f"coalesce({u64.modular(n)}, CAST(0 AS DECIMAL(20,0))) AS {n}" for n, _ in outs])


def multiply(parts: Sequence[DataFrame]) -> DataFrame:
    """The weighed product of one-row weighed parts: their rows stand under each other and are put
    together by one aggregate, so nothing is joined."""
    if len(parts) == 1:
        return parts[0]
    all_sums = [c for df in parts for c in df.columns if c.startswith("sum_")]
    stacked = None
    for i, df in enumerate(parts):
        own = df.selectExpr(*[f"{f'{COUNT}' if k == i else 'CAST(NULL AS DECIMAL(20,0))'} AS _{k}" for k in range(len(parts))], *[f"{c if c in df.columns else 'CAST(NULL AS DECIMAL(20,0))'} AS {c}" for c in all_sums])
        stacked = own if stacked is None else stacked.unionAll(own)
    one = stacked.agg(*[F.expr(f"max({c}) AS {c}") for c in stacked.columns])
    for i, df in enumerate(parts):
        for k in range(len(parts)):
            if k != i:
                one = one.selectExpr(*[f"{u64.product(c, f'_{k}')} AS {c}" if c in df.columns else c for c in one.columns])
    one = one.selectExpr("*", f"_0 AS {COUNT}")
    for k in range(1, len(parts)):
        one = one.selectExpr(*[c for c in one.columns if c != COUNT], f"{u64.product(COUNT, f'_{k}')} AS {COUNT}")
    return one.select(COUNT, *all_sums)


def outputs(weighed: DataFrame, columns: Sequence[str], places: Sequence[int], result: str = "u64") -> DataFrame:
    """One row s0..sN of a weighed row's sums, null for zero. ``result``: u64 (DECIMAL(20,0)) or
    bigint (the sum's bits)."""
    form = u64.as_bigint if result == "bigint" else str
    totals = weighed.selectExpr(*[f"{u64.zero_as_null(f'sum_{c}')} AS _{i}" for i, c in enumerate(columns)])
    return totals.selectExpr(*[f"{form(f'_{k}')} AS s{i}" for i, k in enumerate(places)])


def checksum(df: DataFrame, columns: Sequence[str], places: Sequence[int], result: str = "u64") -> DataFrame:
    """One row s0..sN of the columns' sums modulo 2**64, null for zero."""
    aggs, totals = _sums(columns)
    form = u64.as_bigint if result == "bigint" else str
    one = df.selectExpr(*aggs).selectExpr(*[f"{u64.zero_as_null(totals[c])} AS _{i}" for i, c in enumerate(columns)])
    return one.selectExpr(*[f"{form(f'_{k}')} AS s{i}" for i, k in enumerate(places)])
