"""Near-duplicate groups by bottom-k sketches.

One hash function orders every document's shingle hashes; the k smallest are its sketch. Inverted
lists of retained values generate overlaps, the union sketch (the k smallest of two sketches
together) estimates the similarity, and the exact Jaccard of the full sets confirms each link.

How it stays whole and linear where it can:

* documents with equal sets are one class, so exact copies never pair up;
* in lists, each class stands only under its rarest values. Two classes that share ``o`` of their
  retained values share one of the first ``len - o + 1`` in any common order, and order is by
  rarity, so frequent passages generate nothing unless a document consists of them. For sets of
  more than k values ``o`` is ``MIN_SHARED``: at a similarity of 0.85 fewer than 12 of 32 shared
  values come about with a probability below 1e-9. Smaller sets are retained whole and the bound is
  exact; with ``k=None`` all sets are, at the price of longer sketches;
* lists with the same members are one list, and a pair is worked on in the smallest list it shares;
* a long list is cut into blocks and worked on as pairs of blocks, each of bounded size, and only
  a spanning forest of the confirmed links leaves a block: links inside a known component are
  not needed for components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C
from sumweave.llm.components import connected

K = 32
MIN_SHARED = 12
#: Shingles to a block of a list (bounds a task's memory), and members compared at once within it.
BLOCK = 1_000_000
TILE = 192

#: Pairs whose union sketches are looked at at once.
PAIRS = 4096
#: Sketch size when sets are retained whole.
WHOLE = 1 << 40

SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])
SKETCH_SQL = "doc_id long, text_hash long, n_shingles long, digest binary, sketch array<long>"


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(C.windows(C.word_hashes(text.lower().split()), words))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _sketches(words: int, k: int):
    def run(it):
        for b in it:
            sets = [shingles(t, words) for t in C.raw_texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], SKETCH.field("sketch").type)], schema=SKETCH
            )

    return run


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def union_shared(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """For each pair of sketches, how many of the k smallest values of both together are in both."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        sides = a[i : i + PAIRS], b[i : i + PAIRS]
        n = len(sides[0])
        owner = np.concatenate([np.repeat(np.arange(n), [len(x) for x in side]) for side in sides])
        values = np.concatenate([*sides[0], *sides[1]])
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        again = np.append(False, (values[1:] == values[:-1]) & (owner[1:] == owner[:-1]))
        rank = np.cumsum(~again)  # of distinct values, over all pairs
        first = np.searchsorted(owner, np.arange(n))
        before = np.append(rank, 0)[first] - 1
        out[i : i + n] = np.bincount(owner[again & (rank - before[owner] <= k)], minlength=n)
    return out


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Similarity by the k smallest of both sketches' values."""
    return int(union_shared([a[:k]], [b[:k]], k)[0]) / max(1, min(k, len(np.union1d(a[:k], b[:k]))))


def _hold(parts: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which sets hold which of the sorted values."""
    out = np.zeros((len(parts), len(values)), np.float32)
    out[np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.searchsorted(values, np.concatenate(parts))] = 1
    return out


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``a`` shares with each of ``b``."""
    values = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(values):
        return np.zeros((len(a), len(b)), np.int64)
    a, b = ([x[np.isin(x, values)] for x in y] for y in (a, b))
    return np.rint(_hold(a, values) @ _hold(b, values).T).astype(np.int64)


def confirm(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, before: list[np.ndarray] | None = None, k: int = K) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union).

    Left out are pairs of one side (their own block's task has them), pairs that share an earlier
    list, pairs in one component already, pairs whose sizes rule a link out, and pairs whose union
    sketch holds too few shared values for any chance of one (all values, if both sets are retained
    whole). Works tile by tile.
    """
    m, out = len(sets), []
    sizes, parent = np.array([len(s) for s in sets], np.int64), np.arange(m)
    for a0 in range(0, m, TILE):
        for b0 in range(a0, m, TILE):
            ia, ib = np.arange(a0, min(m, a0 + TILE)), np.arange(b0, min(m, b0 + TILE))
            small, large = np.minimum.outer(sizes[ia], sizes[ib]), np.maximum.outer(sizes[ia], sizes[ib])
            may = (100 * small >= percent * large) & (ia[:, None] < ib)
            if sides is not None:
                may &= sides[ia][:, None] != sides[ib]
            roots = np.array([_find(parent, x) for x in range(m)]) if out else parent
            may &= roots[ia][:, None] != roots[ib]
            if not may.any():
                continue
            if before is not None and m > 2:
                may &= _shared([before[x] for x in ia], [before[x] for x in ib]) == 0
            x, y = np.nonzero(may)
            need = np.ceil(small[x, y] * percent / 100)
            sketches = [sets[a0 + u][:k] for u in x], [sets[b0 + v][:k] for v in y]
            enough = union_shared(*sketches, k) >= np.where(large[x, y] > k, np.minimum(MIN_SHARED, need), np.minimum(k, need))
            x, y = x[enough], y[enough]
            exact = None
            if len(x) > 400 and len(ia) * int(sizes[ia].sum() + sizes[ib].sum()) < 60_000_000:
                exact = _shared([sets[i] for i in ia], [sets[i] for i in ib])
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                p, q = a0 + u, b0 + v
                rp, rq = _find(parent, p), _find(parent, q)
                if rp == rq:
                    continue
                n = int(exact[u, v]) if exact is not None else len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * n < percent * (sizes[p] + sizes[q] - n):
                    continue
                parent[max(rp, rq)] = min(rp, rq)
                out.append((p, q))
    return out


LINK = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _links(words: int, percent: int, k: int):
    def run(it):
        """Rows sorted by (list, i, j): a group is one pair of blocks."""
        key, held = None, []

        def close(key, held):
            have: dict[bytes, tuple] = {}
            for text, side, lists in held:
                s = shingles(text, words)
                have.setdefault(digest(s), (s, side, lists))
            names = list(have)
            if len(names) < 2:
                return []
            sets, sides, lists = zip(*have.values(), strict=True)
            before = [np.array([x for x in own if x < key[0]], np.int64) for own in lists]
            return [(names[x], names[y]) for x, y in confirm(list(sets), percent, np.array(sides) if key[1] != key[2] else None, before, k)]

        for b in it:
            out = []
            texts = C.raw_texts(b)
            for *at, side, lists, text in zip(*(b.column(c).to_pylist() for c in ("list", "i", "j", "side", "lists")), texts, strict=True):
                if at != key:
                    if held:
                        out += close(key, held)
                    key, held = at, []
                held.append((text, side, lists))
            yield C.batches({"u": [x for x, _ in out], "v": [y for _, y in out]}, LINK)
        if held:
            out = close(key, held)
            yield C.batches({"u": [x for x, _ in out], "v": [y for _, y in out]}, LINK)

    return run


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, k: int | None = K) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), text_hash.

    Similarity is over distinct shingles of ``words`` words; links need 100 * intersection >=
    percent * union. A text without words (null, empty) has no shingle and links with nothing, so
    its component is itself. Rows that repeat a doc_id each come out. A row with a null doc_id
    takes part in links; its component is the smallest id of its group, null if there is none, and
    it is kept only in the latter case. Other columns are ignored; an empty table gives no rows.
    Texts are read whole, however long. ``k`` is the sketch size; None retains all sets whole, which
    makes the search exact for every size of set.
    """
    spark, k = docs.sparkSession, k or WHOLE
    C.prepare(spark)
    docs = C.id_text(docs, _text_hash().alias("text_hash"))
    sk = C.written(docs.mapInArrow(_sketches(words, k), SKETCH_SQL), "sketches")
    classes = sk.where("n_shingles > 0").groupBy("digest").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))

    def bound(n):
        """How many of the values a class must stand under."""
        whole = n - F.ceil(n * percent / 100) + 1
        own = F.least(n, F.lit(k))
        return F.when(n * 100 < F.lit(k) * percent, whole).otherwise(own - F.least(F.lit(MIN_SHARED), F.ceil(n * percent / 100)) + 1)

    post = classes.select("digest", "n", F.explode("sketch").alias("value"))
    common = post.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = (
        post.join(common, "value")
        .groupBy("digest")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
        .withColumn("take", bound(F.col("n")) - (F.least("n", F.lit(k)) - F.size("own")))
        .where("take > 0")
        .select("digest", "n", F.explode(F.expr("slice(own, 1, cast(take as int))")).alias("p"))
        .select("digest", "n", F.col("p.value").alias("list"))
    )
    rare = C.written(rare, "lists")
    lists = rare.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.expr("bit_xor(xxhash64(digest))").alias("x"), F.expr("bit_xor(xxhash64(digest, 1L))").alias("y")).where("size > 1")
    lists = lists.groupBy("size", "total", "x", "y").agg(F.min("list").alias("list")).select("list", "total")
    member = C.written(rare.join(lists, "list"), "members")
    own = member.groupBy("digest").agg(F.sort_array(F.collect_list("list")).alias("lists"))
    blocks = F.ceil(F.col("total") / F.lit(BLOCK)).cast("int")
    # each class is worked on by the text of one of its rows, told by id (null: the least number) and text
    no_id = F.lit(-(1 << 63))
    rep = sk.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("rep"), "text_hash")).alias("r")).select("digest", "r.*")
    work = (
        member.join(own, "digest")
        .join(rep, "digest")
        .withColumn("side", F.pmod(F.xxhash64("digest", F.lit(7)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("rep", "text_hash", "list", "lists", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    texts = docs.select(F.coalesce("doc_id", no_id).alias("rep"), "text_hash", "text")
    texts = texts.where("rep > -9223372036854775808").unionByName(texts.where("rep = -9223372036854775808").groupBy("rep", "text_hash").agg(F.first("text").alias("text")))
    tasks = work.join(texts, ["rep", "text_hash"]).select("list", "i", "j", "side", "lists", "text").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    links = C.written(tasks.mapInArrow(_links(words, percent, k), "u binary, v binary"), "links")
    roots = connected(links)
    grouped = sk.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    label = grouped.join(least, "root").select("digest", "component")
    out = sk.drop("sketch").join(label, "digest", "left")
    comp = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"), "text_hash")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and those in none. Rows are told by
    doc_id and text; of equal ones one stays."""
    kept = C.written(near_groups(docs, words, percent).where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n")), "kept")
    own = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_hash": _text_hash()})
    same = own["_id"].eqNullSafe(kept["doc_id"]) & (own["_hash"] == kept["text_hash"])
    once = own.join(kept.where("_n = 1"), same, "left_semi").select(*docs.columns)
    many = own.join(kept.where("_n > 1"), same, "left_semi").select("_id", "_hash", F.struct(*docs.columns).alias("_row"))
    return once.union(many.groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2_near_dedup."""
    return near_groups(C.table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_hash")
