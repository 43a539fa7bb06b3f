"""Benchmark decontamination: 3-gram seeds, then Smith-Waterman alignment.

Every window of three words of a test item is a seed (an item of one or two words is its own). The
distinct seeds' hashes go to the tasks, in blocks of bounded size; a pass over the corpus finds them,
common ones too, and cuts the passages around them, as long as the longest item with that seed can
reach. Passages then meet items in a join by seeds. A passage that shares too few words with the
item to reach the score is left out (a bound that loses none); the others are aligned with the item
by words, and one that reaches the score is a leak, edited or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C
from sumweave.llm.mixing import n_words

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score of a leak, as a share of the item's with itself.
SCORE = 0.5
#: Distinct seeds to a block (12 bytes each); a pass over the corpus serves one block.
SEEDS = 2_000_000

ITEMS = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("words", pa.binary()), ("n", pa.int32()), ("seeds", pa.list_(pa.int64()))])
ITEMS_SQL = "key long, item_id long, words binary, n int, seeds array<long>"
PASSAGES = pa.schema([("pid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
PASSAGES_SQL = "pid long, doc_id long, text_hash long, first long, words binary, seeds array<long>, places array<int>"
HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
HITS_SQL = "doc_id long, text_hash long, key long, item_id long, score double, first_word long, last_word long"


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best score, first and last position of the aligned stretch in the passage)."""
    n = len(passage)
    step = np.arange(n + 1) * GAP
    h, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, -1)
    for w in item.tolist():
        diag = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        t, o = np.zeros(n + 1, np.int64), np.arange(n + 1)
        t[1:] = np.maximum(0, np.maximum(diag, up))
        o[1:] = np.where(t[1:] == 0, o[1:], np.where(diag >= up, start[:-1], start[1:]))
        key = t - step
        run = np.maximum.accumulate(key)
        at = np.maximum.accumulate(np.where(key == run, np.arange(n + 1), 0))
        h = run + step
        start = o[at]
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k - 1)
    return best


def _seeds(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words, none for fewer."""
    return C.windows(words, n).view(np.int64) if len(words) >= n else np.zeros(0, np.int64)


def _items(it):
    key = TaskContext.get().partitionId() << 36
    for b in it:
        split = [C.word_hashes(t.lower().split()) for t in C.raw_texts(b)]
        yield C.batches({"key": range(key, key + len(split)), "item_id": b.column("item_id").to_pylist(), "words": [w.tobytes() for w in split], "n": [len(w) for w in split], "seeds": [_seeds(w, min(SEED_WORDS, len(w))) if len(w) else [] for w in split]}, ITEMS)
        key += len(split)


def _cut(seeds, reach, kinds: list[int]):
    """The passages around seeds. ``seeds``: sorted hashes; ``reach``: words of the longest item with
    each; ``kinds``: the seeds' numbers of words."""

    def run(it):
        pid, known, far = TaskContext.get().partitionId() << 36, seeds.value, reach.value
        for b in it if len(known) else ():
            out = {c: [] for c in PASSAGES.names}
            for d, th, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), C.raw_texts(b), strict=True):
                w = C.word_hashes(t.lower().split())
                at, which = [], []
                for n in kinds:
                    g = _seeds(w, n)
                    k = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    hit = np.flatnonzero(known[k] == g)
                    if n < SEED_WORDS:  # a short item counts where it stands first
                        hit = hit[np.unique(g[hit], return_index=True)[1]]
                    at.append(hit)
                    which.append(k[hit])
                at, which = np.concatenate(at), np.concatenate(which)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, which = at[order], which[order]
                n = far[which].astype(np.int64)
                lo, hi = np.maximum(at - n - n // 2, 0), np.minimum(at + n + n // 2, len(w))
                order = np.argsort(lo, kind="stable")
                at, which, lo, hi = at[order], which[order], lo[order], np.maximum.accumulate(hi[order])
                cuts = [0, *(np.flatnonzero(lo[1:] > hi[:-1]) + 1).tolist(), len(at)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    first, last = int(lo[a]), int(hi[z - 1])
                    row = (pid, d, th, first, w[first:last].tobytes(), known[which[a:z]], (at[a:z] - first).astype(np.int32))
                    for c, v in zip(PASSAGES.names, row, strict=True):
                        out[c].append(v)
                    pid += 1
            yield C.batches(out, PASSAGES)

    return run


def reaches(item: np.ndarray, passage: np.ndarray, score: float) -> bool:
    """Whether the words the passage shares with an item could make the score."""
    words, need = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    have = np.bincount(at[words[at] == passage], minlength=len(words))
    return int(np.minimum(have, need).sum()) >= score * len(item)


def best_alignment(item: np.ndarray, passage: np.ndarray, starts: list[int], score: float) -> tuple[float, int, int]:
    """(share of the item's own score, first, last word) of the best stretch about ``starts``, where the
    item would begin by its seeds."""
    n = len(item)
    if n < SEED_WORDS:
        return 1.0, min(starts), min(starts) + n - 1
    spans: list[list[int]] = []
    for s in sorted(starts):
        lo, hi = max(0, s - n // 2), min(len(passage), s + n + n // 2)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    best = (0.0, 0, -1)
    for lo, hi in spans:
        for a in range(lo, hi, 8 * n):  # long runs of hits in stretches that overlap by two items
            part = passage[a : min(hi, a + 10 * n)]
            if reaches(item, part, score):
                got, first, last = smith_waterman(item, part)
                if got / (MATCH * n) > best[0]:
                    best = (got / (MATCH * n), a + first, a + last)
    return best


def _align(score: float):
    def run(it):
        for b in it:
            out = {c: [] for c in HITS.names}
            for d, th, key, item_id, offset, item, words, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "key", "item_id", "first", "item", "words", "starts")), strict=True):
                got, first, last = best_alignment(np.frombuffer(item, np.uint64), np.frombuffer(words, np.uint64), starts, score)
                if got >= score:
                    for c, v in zip(HITS.names, (d, th, key, item_id, got, offset + first, offset + last), strict=True):
                        out[c].append(v)
            yield C.batches(out, HITS)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, text_hash, item_id, score, first_word, last_word for each item a document holds.

    Words are compared with A-Z lowered. Items of one or two words match where they stand whole;
    items without words and null texts match nothing. Texts are searched whole, of any length; of
    passages with equal scores the first counts. Rows that repeat an item_id are matched each; rows of
    one doc_id and text come out once. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    rows = C.id_text(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    items = C.written(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_items, ITEMS_SQL), "items")
    places = items.select("key", "n", F.posexplode("seeds").alias("at", "seed"))
    seeds = C.written(places.groupBy("seed").agg(F.max("n").alias("reach")), "seeds")
    total, kinds = seeds.count(), sorted({min(SEED_WORDS, r[0]) for r in items.where("n > 0").select(F.least("n", F.lit(SEED_WORDS))).distinct().collect()})
    passages = None
    for block in range(blocks := max(1, -(-total // SEEDS))):
        mine = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block).toArrow().sort_by("seed")
        if total:
            sent = [spark.sparkContext.broadcast(mine[c].to_numpy()) for c in ("seed", "reach")]
            found = rows.mapInArrow(_cut(*sent, kinds), PASSAGES_SQL)
        else:
            found = spark.createDataFrame([], PASSAGES_SQL)
        found = C.written(found, "passages").withColumn("block", F.lit(block))
        passages = found if passages is None else passages.unionByName(found)
    hits = passages.select("block", "pid", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("block", "pid", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    pairs = hits.join(places, "seed").groupBy("block", "pid", "key").agg(F.collect_set(F.col("place") - F.col("at")).alias("starts"))
    pairs = pairs.join(passages.select("block", "pid", "doc_id", "text_hash", "first", "words"), ["block", "pid"]).join(items.select("key", "item_id", F.col("words").alias("item")), "key")
    out = pairs.select("doc_id", "text_hash", "key", "item_id", "first", "item", "words", "starts").mapInArrow(_align(score), HITS_SQL)
    best = out.groupBy("doc_id", "text_hash", "key").agg(F.max(F.struct("score", (-F.col("first_word")).alias("first"), "last_word", "item_id")).alias("b"))
    return best.select("doc_id", "text_hash", "b.item_id", "b.score", (-F.col("b.first")).alias("first_word"), "b.last_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item of SEED_WORDS words or more (shorter ones stand in
    any text and show no leak)."""
    bad = leaks(docs, benchmark.where(n_words(F.col("text").cast("string")) >= SEED_WORDS), score).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op9_decontamination."""
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("text_hash")
