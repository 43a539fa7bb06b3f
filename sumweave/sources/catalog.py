"""The relation registry and its column statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumweave.functions import u64
from sumweave.plans.model import Filter
from sumweave.sources import colbin

#: The sampled distinct count looks at about this many rows of a relation.
SAMPLE_ROWS = 1300


class Catalog:
    """Relations by id. ``add`` numbers them in load order and registers the views r0, r1, ..."""

    def __init__(self, spark: SparkSession, views: bool = True):
        self.spark, self.views = spark, views
        self._relations: dict[int, DataFrame] = {}
        self._max: dict[tuple[int, int], int] = {}
        self._keys: dict[int, tuple[frozenset[int], ...]] = {}
        self._widths: dict[int, int] = {}
        self._narrowed: dict[int, Callable[[Sequence[Filter]], DataFrame]] = {}

    def add(self, df: DataFrame, relation: int | None = None, keys: Sequence[Sequence[int]] = (), narrowed: Callable[[Sequence[Filter]], DataFrame] | None = None, width: int | None = None) -> int:
        """``keys``: sets of columns no two rows agree in, as far as declared (plans are chosen by them,
        results don't depend on it). ``width``: the number of columns, given where they are named c0, c1, ...
        already. ``narrowed`` gives the relation without some of the rows that
        constant filters drop, where its columns are computed from stored ones a scan can prune by."""
        rid = len(self._relations) if relation is None else relation
        self._keys[rid] = tuple(map(frozenset, keys))
        if narrowed:
            self._narrowed[rid] = narrowed
        self._widths[rid] = len(df.columns) if width is None else width
        if width is None:
            df = df.toDF(*[f"c{i}" for i in range(self._widths[rid])])
        self._relations[rid] = df
        if self.views:
            df.createOrReplaceTempView(f"r{rid}")
        return rid

    def add_file(self, path: str, stage: str | None = None) -> int:
        """A binary column file; ``stage`` names a folder for a Parquet copy, which gives queries
        column pruning and filter pushdown."""
        df = colbin.read(self.spark, path)
        if stage:
            df.write.mode("overwrite").parquet(stage)
            df = self.spark.read.parquet(stage)
        return self.add(df)

    def add_parquet(self, path: str) -> int:
        return self.add(self.spark.read.parquet(path))

    def add_rows(self, columns: list[list[int]]) -> int:
        """In-memory columns of unsigned values."""
        import pyarrow as pa

        t = pa.table({f"c{i}": pa.array([u64.signed(v) for v in c], pa.int64()) for i, c in enumerate(columns)})
        return self.add(self.spark.createDataFrame(t))

    def relation(self, rid: int) -> DataFrame:
        if rid not in self._relations:
            raise KeyError(f"no relation {rid}; there are {sorted(self._relations)}")
        return self._relations[rid]

    def width(self, rid: int) -> int:
        self.relation(rid)
        return self._widths[rid]

    def narrowed(self, rid: int, filters: Sequence[Filter]) -> DataFrame:
        """A relation, perhaps without rows that the filters drop (which are still to be applied)."""
        return self._narrowed[rid](filters) if filters and rid in self._narrowed else self.relation(rid)

    def unique(self, rid: int, columns: set[int]) -> bool:
        """Whether a declared key is among the columns."""
        return any(k <= columns for k in self._keys.get(rid, ()))

    def __len__(self) -> int:
        return len(self._relations)

    def row_at(self, rid: int, index: int, order: str | None = None) -> list[int]:
        """One row as unsigned values. A DataFrame has no order of its own: give ``order``, or the
        order of a single file's rows is taken."""
        df = self.relation(rid)
        df = df.orderBy(order) if order else df
        rows = df.offset(index).limit(1).collect()
        if not rows:
            raise IndexError(index)
        return [u64.unsigned(v) for v in rows[0]]

    def statistics(self, rid: int, exact: bool = False) -> DataFrame:
        """One row a column: relation, col, n_rows, distinct, min, max (DECIMAL(20,0), unsigned).

        An empty relation has min 2**64-1 and max 0. ``distinct`` is approximate unless ``exact``.
        """
        df = self.relation(rid)
        count = F.count_distinct if exact else F.approx_count_distinct
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(df.columns):
            o = u64.ordered(F.col(c))
            aggs += [count(c).alias(f"d{i}"), F.min(o).alias(f"lo{i}"), F.max(o).alias(f"hi{i}")]
        dec = lambda c, z: F.coalesce(F.when(u64.unordered(c) < 0, u64.unordered(c).cast("decimal(20,0)") + F.lit(str(u64.MOD)).cast("decimal(20,0)")).otherwise(u64.unordered(c).cast("decimal(20,0)")), F.lit(str(z)).cast("decimal(20,0)")).cast("decimal(20,0)")
        cols = [F.struct(F.lit(rid).alias("relation"), F.lit(i).alias("col"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), dec(F.col(f"lo{i}"), u64.MOD - 1).alias("min_value"), dec(F.col(f"hi{i}"), 0).alias("max_value")) for i in range(len(df.columns))]
        return df.agg(*aggs).select(F.explode(F.array(cols)).alias("s")).select("s.*")

    def sampled_distinct(self, rid: int, row_column: str) -> DataFrame:
        """Distinct values among every k-th row, k = max(1, rows // 1300), rows numbered by a
        column of dense numbers."""
        df = self.relation(rid)
        k = max(1, df.count() // SAMPLE_ROWS)
        return df.where(F.col(row_column) % k == 0).agg(*[F.count_distinct(c).alias(c) for c in df.columns])

    def analyze(self, workers: int = 4) -> None:
        """Collect each relation's maxima (one row), several relations at a time;
        filters on columns proven below 2**63 are then plain comparisons."""
        def one(rid: int) -> None:
            df = self.relation(rid)
            if df.columns:
                for i, v in enumerate(df.agg(*[F.max(u64.ordered(F.col(c))) for c in df.columns]).collect()[0]):
                    self._max[rid, i] = 0 if v is None else v + u64.TOP

        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(one, self._relations))

    def non_negative(self, rid: int, column: int) -> bool:
        return self._max.get((rid, column), u64.MOD) < u64.TOP
