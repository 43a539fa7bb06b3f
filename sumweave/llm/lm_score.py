"""Scores of texts under language models learnt from the corpus.

The base is an add-one unigram model over words and an end token. The model proper is a causal
self-attention model (``attention``) over subword ids. All training documents train both; every
document is scored:

1. encode: subword ids to a table in the shared folder, with the training documents' word and
   subword counts (added up in each task first, then by Spark);
2. train: training documents are dealt into shards of about SHARD subwords by a hash of id and
   text, and stand in a shard in the order of another. The first shard trains the start; every other
   shard trains a copy of it, and the copies' mean is the model: by steps for what all subwords
   share, by the steps that held it for a subword's own row. Pairs of subwords in a row are counted
   on the way. Shards and their order depend on the rows alone, so scores don't depend on
   partitions (but for rounding in sums);
3. score: overlapping windows by the trained model; words by the counts. The HEAD most frequent
   words' counts go to the tasks (a fixed number of them); all other words meet their counts in a join.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import attention as A
from sumweave.llm import common as C
from sumweave.llm.token_counts import PATTERN

FOLDS, HELD_OUT = 7, 2
#: Words whose counts are sent to every task.
HEAD = 1 << 16
#: Distinct words a worker numbers before it starts afresh (a memory bound; results don't depend on it).
WORDS = 1_000_000
#: Bytes of text worked on at once, and words when their subwords are counted.
GROUP, RUN = 4_000_000, 1 << 17
#: Subwords to a training shard, about; tasks that train at most (a task takes its shards in turn).
SHARD, TASKS = 2_000_000, 20_000
#: Subwords trained on at once, and how often the first shard's are.
CHUNK, FIRST_PASSES = 1 << 18, 2
#: Subwords and pairs to a part of what the tasks' models are put together from, and partitions that do so.
PART, PAIRS, PARTS = 4096, 1 << 20, 8
#: The end token's key; no word holds a blank.
END = xxhash.xxh64_intdigest(b" end")

CODES = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
CODES_SQL = "kind int, doc_id long, text_hash long, held_out boolean, ids binary, key long, n long"


def code_type(end_id: int) -> str:
    return "<u2" if end_id < 1 << 16 else "<u4"


def held_out(doc_id) -> bool:
    """Whether a document is kept from training: crc32 of its id as text, by 7, leaves 2. A null
    id has an empty text (and trains)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _groups(texts: pa.Array):
    """(first, last) of runs of texts of about GROUP bytes (a longer text is a run of its own)."""
    a = size = 0
    for z, n in enumerate(pc.binary_length(texts).to_pylist()):
        if z > a and size + n > GROUP:
            yield a, z
            a, size = z, 0
        size += n
    if len(texts):
        yield a, len(texts)


class Numbers:
    """Words by number in the order they come, and columns of values by number."""

    def __init__(self, describe):
        """``describe`` gives the columns' values of a list of new words."""
        self.at: dict[bytes, int] = {}
        self.describe = describe
        self.columns: list[np.ndarray] = []

    def of(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words of which none comes twice."""
        k = np.fromiter(map(self.at.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            base = len(self.at)
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
            values = self.describe(new)
            if not base:
                self.columns = [np.zeros(0, v.dtype) for v in values]
            for i, v in enumerate(values):
                if base + len(v) > len(self.columns[i]):
                    self.columns[i] = np.concatenate([self.columns[i], np.zeros(base + 2 * len(v) + 1000, v.dtype)])
                self.columns[i][base : base + len(v)] = v
            k[unknown] = np.arange(base, base + len(new))
        return k


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Subwords:
    """Subword ids of lower-cased words, each with one blank before it, by a file of ranks.

    Words are encoded many at a time: a blank always begins a new piece, so ids fall to words by their
    bytes. Words with white space beyond ASCII in them could join pieces and go alone.
    """

    ODD = re.compile(r"[^\S \t-\r]|[\x1c-\x1f\x85]")

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(x) for x in ranks]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has)."""
        text = (b" " + b" ".join(words)).decode()
        if not self.ODD.search(text):
            ids = np.array(self.encode(text), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            return ids, np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1, prepend=0)
        alone = np.fromiter((bool(self.ODD.search(w.decode())) for w in words), bool, len(words))
        parts: list = [self.encode(" " + w.decode()) if x else None for w, x in zip(words, alone.tolist(), strict=True)]
        plain = [w for w, x in zip(words, alone.tolist(), strict=True) if not x]
        if plain:
            ids, n = self.of(plain)
            for k, own in zip(np.flatnonzero(~alone).tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[k] = own
        return np.concatenate([np.array(x, np.uint32) for x in parts]), np.array([len(x) for x in parts])


_SUBWORDS: dict[str, Subwords] = {}
#: What a worker knows of words by tokenizer, from task to task.
_STATES: dict[str, dict] = {}


def subwords(path: str) -> Subwords:
    """The worker's encoder for a file; it lives as long as the worker."""
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then those from first[1] on, and so forth."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _forget() -> None:
    """Give up this worker's caches, for passes that need their memory for something else."""
    C.forget()
    _STATES.clear()


def _encode(tokenizer: str, end_id: int):
    def rows(kind: int, keys, counts):
        n = len(keys)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.binary()), pa.array(keys), pa.array(counts)], schema=CODES)

    def run(it):
        C.forget()
        sub, vocab, dtype = subwords(tokenizer), end_id + 1, code_type(end_id)
        end, counted = np.array([end_id], dtype).tobytes(), np.zeros(vocab, np.int64)
        state = _STATES.setdefault(tokenizer, {})

        def afresh():
            state.update(stream=np.zeros(0, dtype), used=0, counts=np.zeros(0, np.int64), numbers=Numbers(describe))

        def describe(new):
            ids, size = sub.of(new)
            u, z = state["used"], state["used"] + len(ids)
            if z > len(state["stream"]):
                state["stream"] = np.concatenate([state["stream"], np.zeros(z + len(ids), dtype)])
            state["stream"][u:z] = ids
            state["used"] = z
            return u + np.cumsum(size) - size, size, _hashes(new).view(np.int64)

        def flush():
            nonlocal counted
            n = state["counts"]
            k = np.flatnonzero(n)
            if len(k):
                first, size, key = state["numbers"].columns
                for a in range(0, len(n), RUN):  # words' subwords stand by number
                    c, s = n[a : a + RUN], size[a : a + RUN][: len(n) - a]
                    counted += np.bincount(state["stream"][first[a] : first[a] + s.sum()], np.repeat(c, s), vocab).astype(np.int64)
                yield rows(1, key[k], n[k])
            state["counts"] = np.zeros(0, np.int64)

        if not state:
            afresh()
        state["counts"] = np.zeros(0, np.int64)
        state["numbers"].describe = describe
        trained = 0
        for b in it:
            ids, texts, codes = b.column("doc_id").to_pylist(), C.strings(b), []
            held = np.fromiter(map(held_out, ids), bool, len(ids))
            for a, z in _groups(texts):
                if len(state["numbers"].at) > WORDS:
                    yield from flush()
                    afresh()
                n, at, words = C.lower_words(texts.slice(a, z - a))
                if not words:
                    codes += [end] * (z - a)
                    continue
                k = state["numbers"].of(words)
                first, size, _ = state["numbers"].columns
                first, size = first.take(k).take(at), size.take(k).take(at)
                stream = state["stream"].take(spans(first, size))
                cuts = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))].tolist()
                codes += [stream[x:y].tobytes() + end for x, y in zip(cuts, cuts[1:], strict=False)]
                if len(state["numbers"].at) > len(state["counts"]):
                    state["counts"] = np.append(state["counts"], np.zeros(len(state["numbers"].at) - len(state["counts"]), np.int64))
                state["counts"][k] += np.bincount(at[np.repeat(~held[a:z], n)], minlength=len(words))
            trained += int((~held).sum())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column("doc_id"), b.column("text_hash"), pa.array(held), pa.array(codes, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=CODES)
        yield from flush()
        if trained:
            counted[end_id] += trained
            k = np.flatnonzero(counted)
            yield rows(2, k, counted[k])
            yield rows(1, np.array([END], np.uint64).view(np.int64), np.array([trained]))

    return run


MEANS_SQL = "part int, rows binary, weights binary, x binary"


def _means(parts) -> pa.RecordBatch:
    """Rows (part, row numbers, their weights, their values) as a batch."""
    part, rows, weights, x = zip(*parts, strict=True)
    data = [[np.ascontiguousarray(v, t).tobytes() for v in c] for c, t in ((rows, np.int32), (weights, np.float64), (x, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(c, pa.binary()) for c in data]], names=["part", "rows", "weights", "x"])


def _train(model, batch: int, passes: int, dtype: str):
    """Rows sorted by shard and place: each shard trains a copy of ``model``; the sums of the copies,
    weighted (part 0: shared, part 1 + p: subwords), and of pairs (part -1 - p) come out at the end."""

    def run(it):
        _forget()
        sums: dict[int, list] = {}
        start = A.Model(*model.value)
        pairs = np.zeros(start.vocab.PAIRS, np.int32)
        t, at, held, size = None, None, [], 0

        def add(part, rows, weights, x):
            total, weight = sums.setdefault(part, [np.zeros((PART if part else 1, x.shape[1])), np.zeros(PART if part else 1)])
            total[rows] += x * weights[:, None]
            weight[rows] += weights

        def learn():
            nonlocal held, size
            if held:
                x, y, _ = t.model.windows(held)
                t.learn(x, y, passes)
                met = np.sort(start.vocab.pairs(x, y).astype(np.int32))
                first = np.flatnonzero(np.diff(met, prepend=-1))
                pairs[met[first]] += np.diff(first, append=len(met)).astype(np.int32)
            held, size = [], 0

        def close():
            learn()
            if t is not None and t.n:
                add(0, np.zeros(1, int), np.array([float(t.n)]), t.model.flat[None])
                met = np.flatnonzero(t.seen)
                for p in np.unique(met // PART).tolist():
                    r = met[met // PART == p]
                    add(1 + p, r % PART, t.seen[r].astype(float), t.model.own[r])

        for b in it:
            for shard, x in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if shard != at:
                    close()
                    at, t = shard, A.Trainer(A.Model(start.flat, start.vocab, start.own), batch)
                held.append(np.frombuffer(x, dtype))
                size += len(held[-1])
                if size > CHUNK:
                    learn()
        close()
        parts = [(part, r := np.flatnonzero(weight), weight[r], total[r]) for part, (total, weight) in sums.items()]
        met = np.flatnonzero(pairs)
        for p in np.unique(met // PAIRS).tolist():
            r = met[met // PAIRS == p]
            parts.append((-1 - p, r % PAIRS, np.zeros(0), pairs[r]))
        if parts:
            yield _means(parts)

    return run


def _mean(widths: tuple[int, int]):
    """Weighted means by part and row (sums of pairs), over the tasks' rows as they come."""

    def run(it):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in it:
            for part, rows, weights, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n, width = (PAIRS, 1) if part < 0 else (PART, widths[1]) if part else (1, widths[0])
                total, weight = sums.setdefault(part, (np.zeros((n, width)), np.zeros(n)))
                r, x = np.frombuffer(rows, np.int32), np.frombuffer(x, np.float64).reshape(-1, width)
                total[r] += x
                weight[r] += 1 if part < 0 else np.frombuffer(weights, np.float64)
        parts = []
        for part, (total, weight) in sums.items():
            r = np.flatnonzero(weight)
            first = (-1 - part) * PAIRS if part < 0 else max(part - 1, 0) * PART
            parts.append((part, first + r, np.zeros(0), total[r] if part < 0 else total[r] / weight[r][:, None]))
        if parts:
            yield _means(parts)

    return run


def _score(model, dtype: str):
    def run(it):
        _forget()
        flat, vocab, own, pairs = model.value
        m = A.Model(flat, vocab, own, vocab.within(*pairs))
        for b in it:
            out = []
            raw = [np.frombuffer(x, dtype) for x in b.column("ids").to_pylist()]
            a = 0
            while a < len(raw):
                z, size = a, 0
                while z < len(raw) and (z == a or size + len(raw[z]) < CHUNK):
                    size += len(raw[z])
                    z += 1
                x, y, owner = m.windows(raw[a:z])
                sums = np.bincount(owner, m.log_probs(x, y).sum(1), z - a)
                out += (sums / np.log(10)).tolist()
                a = z
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(out, pa.float64())], names=["doc_id", "text_hash", "score"])

    return run


BASE_SQL = "doc_id long, text_hash long, held_out boolean, n_tokens long, head_n long, head_sum double, row long, tail array<long>, tail_n array<int>"


def _base(keys: np.ndarray, values: np.ndarray, end: float):
    """``keys``: the head words' hashes, sorted; ``values``: log10 of their counts + 1; ``end``: the end token's."""

    def run(it):
        from pyspark import TaskContext

        _forget()
        row = TaskContext.get().partitionId() << 36
        for b in it:
            out: list[list] = [[] for _ in range(6)]
            texts = C.strings(b)
            for a, z in _groups(texts):
                n, at, words = C.lower_words(texts.slice(a, z - a))
                h, v = _hashes(words), np.full(len(words), np.nan)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    v = np.where(keys[place] == h, values[place], np.nan)
                owner, v = np.repeat(np.arange(z - a), n), v.take(at)
                known = ~np.isnan(v)
                head_n, head_sum = np.bincount(owner[known], minlength=z - a), np.bincount(owner[known], v[known], z - a)
                pair, times = np.unique(owner[~known] * max(1, len(words)) + at[~known], return_counts=True)
                owner, tail = np.divmod(pair, max(1, len(words)))
                for c, x in zip(out, (n + 1, head_n + (end >= 0), head_sum + max(end, 0.0), h[tail].view(np.int64), np.bincount(owner, minlength=z - a), times.astype(np.int32)), strict=True):
                    c.append(x)
            if not len(texts):
                continue
            n, head_n, head_sum, tail, sizes, times = map(np.concatenate, out)
            bounds = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(list(map(held_out, b.column("doc_id").to_pylist())), pa.bool_()), *map(pa.array, (n, head_n, head_sum, rows)), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (tail, times))],
                names=["doc_id", "text_hash", "held_out", "n_tokens", "head_n", "head_sum", "row", "tail", "tail_n"],
            )

    return run


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _fitted(codes: DataFrame, counts: np.ndarray, dtype: str) -> tuple:
    """The model's parts (flat, vocabulary, own, pairs) from the training rows of ``codes`` and the
    subwords' counts in them. All of them are bounded by the vocabulary."""
    spark = codes.sparkSession
    vocab = A.Vocabulary(counts)
    m = A.Model(A.initial(vocab.class_share), vocab)
    flat, own, pairs = m.flat, m.own, np.zeros(vocab.PAIRS, np.int64)
    shards = max(1, -(-int(counts.sum()) // SHARD))
    place = F.xxhash64("text_hash", "doc_id", F.lit(1))
    rows = codes.where("kind = 0 and not held_out").select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).alias("shard"), place.alias("place"), "doc_id", "text_hash", "ids")
    order = ["shard", "place", "doc_id", "text_hash"]
    for part, *how in ((rows.where("shard = 0").repartition(1), A.FIRST_BATCH, FIRST_PASSES), (rows.where("shard > 0").repartition(min(shards, TASKS), "shard"), A.BATCH, 1))[: min(shards, 2)]:
        sent = spark.sparkContext.broadcast((flat, vocab, own))
        sums = part.sortWithinPartitions(*order).select("shard", "ids").mapInArrow(_train(sent, *how, dtype), MEANS_SQL)
        flat, own = flat.copy(), own.copy()
        for number, at, _, x in sums.repartition(PARTS, "part").mapInArrow(_mean((A.SIZE, own.shape[1])), MEANS_SQL).collect():
            at, x = np.frombuffer(at, np.int32), np.frombuffer(x, np.float64)
            if number < 0:
                pairs[at] += x.astype(np.int64)
            elif number == 0:
                flat[:] = x
            else:
                own[at] = x.reshape(-1, own.shape[1])
        sent.destroy()
    met = np.flatnonzero(pairs)
    return flat, vocab, own, (met, pairs[met])


def scores(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``tokenizer`` is a file of byte-pair ranks; ``end_id`` an id above all of them. Subwords are of
    words with A-Z lowered and one blank before each. Scores are log10 probabilities of whole texts,
    of any length. A null text is empty: one end token. A null
    doc_id trains. Rows that repeat a doc_id are scored each. With no training document at all the
    counts are 0. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    dtype = code_type(end_id)
    rows = C.id_text(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    codes = C.written(rows.mapInArrow(_encode(tokenizer, end_id), CODES_SQL), "codes", compression="zstd")
    counts = C.written(codes.where("kind = 1").groupBy("key").agg(F.sum("n").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    top = counts.where(F.col("key") != F.lit(_long(END))).orderBy(F.desc("c"), "key").limit(HEAD).collect()
    keys, values = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([np.log10(r[1] + 1.0) for r in top])
    order = np.argsort(keys)
    ends = counts.where(F.col("key") == F.lit(_long(END))).collect()
    end = float(np.log10(ends[0][1] + 1.0)) if ends else -1.0

    sub = np.zeros(end_id + 1, np.int64)
    for k, n in codes.where("kind = 2").groupBy("key").agg(F.sum("n")).collect():
        sub[k] = n
    model = spark.sparkContext.broadcast(_fitted(codes, sub, dtype))
    own = codes.where("kind = 0").select("doc_id", "text_hash", "ids").mapInArrow(_score(model, dtype), "doc_id long, text_hash long, score double")
    own = own.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first("score").alias("score"))

    base = C.written(rows.mapInArrow(_base(keys[order], values[order], end), BASE_SQL), "base")
    tail = base.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("key"), F.col("t.tail_n").alias("k"))
    rare = tail.join(counts, "key").groupBy("row").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("tail_sum"))
    out = base.drop("tail", "tail_n").join(rare, "row", "left").fillna(0, ["tail_known", "tail_sum"])
    out = out.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    per = float(np.log10(total + 1.0 * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_n") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(per)).alias("base_score"), "score"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8_lm_score."""
    import public_tokenizers

    return scores(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 50256)
