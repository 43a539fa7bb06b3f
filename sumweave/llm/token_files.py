"""Token-ID files with a minimal perfect hash index.

A data set is a folder of ``shard-NNNNN.ids`` (raw little-endian ids, documents in ascending key
order over all shards), ``index-NNNNN.mph`` and ``manifest.json``. The index is cut by key hash into
parts of bounded size; each part maps a key through a minimal perfect hash (levels of bit arrays
with the ranks of their blocks, a rank gives the slot) to a slot with a 32-bit fingerprint, the shard,
the offset and the length: constant time a look-up, and absent keys are told by the fingerprint.
``Reader`` looks single keys up; ``read`` does so for a table of keys.

A key is (doc_id, copy): rows that repeat a doc_id are copies 0, 1, ... in text-hash order. A null
doc_id is a key of its own and sorts first; a null or empty text holds the end id alone. Rows of one
doc_id may fill many shards; equal rows (id and text) stand in one.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumweave.llm import common as C

#: Keys to one part of the index, about: bounds a build task's memory.
PART_KEYS = 20_000
#: Bytes of text to a shard at most, about.
SHARD_BYTES = 1 << 28
#: Bits per key at each level of the perfect hash, and bytes to a block that has its rank stored.
GAMMA, BLOCK = 2.0, 64

ENTRY = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
ENTRY_SQL = "doc_id long, copy long, shard int, offset long, n_tokens long"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data, name: str) -> None:
    """Write whole files under a name of the attempt, then rename: a retried task replaces its file
    by equal bytes."""
    fs, root = opened(uri)
    fs.create_dir(root)
    ctx = TaskContext.get()
    tmp = f"{root}/_tmp-{name}-{ctx.taskAttemptId() if ctx else 0}"
    with fs.open_output_stream(tmp) as f:
        for x in data:
            f.write(x)
    fs.move(tmp, f"{root}/{name}")


def key_hash(doc_id: np.ndarray, copy: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    h = C.mix(doc_id.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
    return C.mix(h * np.uint64(31) + C.mix(copy.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + np.uint64(seed)))


def build_levels(doc_id, copy, null) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over (doc_id, copy, null) keys: a key stands in the first
    level where no other falls on its place."""
    levels, left = [], np.arange(len(doc_id))
    while len(left):
        if len(levels) > 200:
            raise ValueError("repeated keys")
        size = max(1, int(GAMMA * len(left)))
        pos = (key_hash(doc_id[left], copy[left], null[left], len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(pos, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[pos]]
    return levels


class PerfectHash:
    """The levels as packed bits with the ranks of their blocks."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def build(cls, doc_id, copy, null) -> PerfectHash:
        bits, ranks, before = [], [], 0
        levels = build_levels(doc_id, copy, null)
        for level in levels:
            packed = np.packbits(level)
            packed = np.append(packed, np.zeros(-len(packed) % BLOCK, np.uint8)).reshape(-1, BLOCK)
            n = np.bitwise_count(packed).sum(1, dtype=np.int64)
            bits.append(packed)
            ranks.append((before + np.cumsum(n) - n).astype("<u4"))
            before += int(n.sum())
        return cls([len(x) for x in levels], bits, ranks)

    def slots(self, doc_id, copy, null) -> np.ndarray:
        """Each key's slot; -1 where no level holds it (then it is no member)."""
        out, left = np.full(len(doc_id), -1, np.int64), np.arange(len(doc_id))
        for k, size in enumerate(self.sizes):
            if not len(left):
                break
            pos = (key_hash(doc_id[left], copy[left], null[left], k + 1) % np.uint64(size)).astype(np.int64)
            block, byte = pos // (8 * BLOCK), pos // 8 % BLOCK
            here = self.bits[k][block, byte]
            hit = (here >> (7 - pos % 8).astype(np.uint8)) & 1 == 1
            pos, block, byte, here = pos[hit], block[hit], byte[hit], here[hit]
            inside = np.where(np.arange(BLOCK) < byte[:, None], self.bits[k][block], 0)
            front = here.astype(np.int64) >> (8 - pos % 8)  # the bits of the key's own byte before it
            out[left[hit]] = self.ranks[k][block] + np.bitwise_count(inside).sum(1, dtype=np.int64) + np.bitwise_count(front)
            left = left[~hit]
        return out


def index_bytes(doc_id, copy, null, shard, offset, length) -> bytes:
    ph = PerfectHash.build(doc_id, copy, null)
    slot = ph.slots(doc_id, copy, null)
    place = lambda x, t: (lambda o: (o.__setitem__(slot, x), o)[1])(np.zeros(len(slot), t))
    out = io.BytesIO()
    out.write(np.array([len(slot), len(ph.sizes), *ph.sizes], "<u8").tobytes())
    for x in (*ph.bits, *ph.ranks, place((key_hash(doc_id, copy, null, 0) >> np.uint64(32)), "<u4"), place(shard, "<u4"), place(offset, "<u8"), place(length, "<u8")):
        out.write(x.tobytes())
    return out.getvalue()


class IndexPart:
    """A part of the index read back from its file (arrays are views of its bytes)."""

    def __init__(self, data: bytes):
        n, m = (int(x) for x in np.frombuffer(data, "<u8", 2))
        sizes, at = np.frombuffer(data, "<u8", m, 16).tolist(), 16 + 8 * m

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        blocks = [-(-size // (8 * BLOCK)) for size in sizes]
        bits = [take("u1", x * BLOCK).reshape(-1, BLOCK) for x in blocks]
        self.ph = PerfectHash(sizes, bits, [take("<u4", x) for x in blocks])
        self.cols = [take(t, n) for t in ("<u4", "<u4", "<u8", "<u8")]

    def get(self, doc_id, copy, null):
        """(found, shard, offset, length) for key arrays."""
        slot = self.ph.slots(doc_id, copy, null)
        safe = np.maximum(slot, 0)
        if not len(self.cols[0]):
            z = np.zeros(len(slot), np.int64)
            return z.astype(bool), z, z, z
        found = (slot >= 0) & (self.cols[0][safe] == (key_hash(doc_id, copy, null, 0) >> np.uint64(32)))
        return found, *(c[safe].astype(np.int64) for c in self.cols[1:])


def part_of(doc_id: int | None, copy: int, parts: int) -> int:
    """The part of a key, as ``_part`` deals them."""
    h = 42
    for x in (doc_id, copy):
        h = h if x is None else xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    return (h - (1 << 64) if h >> 63 else h) % parts


class Reader:
    """Keyed access to a data set from one process."""

    def __init__(self, path: str, cached: int = 64):
        self.fs, self.root = opened(path)
        with self.fs.open_input_file(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.dtype = np.dtype(f"<u{self.manifest['width']}")
        self.cached, self._parts = cached, {}

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """A document's ids, the end id with them; None where there is no such key."""
        if not self.manifest["keys"]:
            return None
        p = part_of(doc_id, copy, self.manifest["parts"])
        if p not in self._parts:
            with self.fs.open_input_file(f"{self.root}/index-{p:05d}.mph") as f:
                self._parts[p] = IndexPart(f.read())
            if len(self._parts) > self.cached:
                self._parts.pop(next(iter(self._parts)))
        found, shard, offset, n = (x[0] for x in self._parts[p].get(np.array([doc_id or 0]), np.array([copy]), np.array([doc_id is None])))
        if not found:
            return None
        with self.fs.open_input_file(f"{self.root}/shard-{shard:05d}.ids") as f:
            return np.frombuffer(f.read_at(int(n) * self.dtype.itemsize, int(offset) * self.dtype.itemsize), self.dtype)


def _write_shards(path: str, tokenizer: str, end_id: int):
    def run(it):
        tok = C.token_cache(tokenizer)
        end = np.array([end_id], tok.dtype).tobytes()
        shard, last, seen, offset = TaskContext.get().partitionId(), object(), 0, 0
        fs, root = opened(path)
        name = f"shard-{shard:05d}.ids"
        tmp = f"{root}/_tmp-{name}-{TaskContext.get().taskAttemptId()}"
        fs.create_dir(root)
        with fs.open_output_stream(tmp, buffer_size=1 << 20) as f:
            for b in it:
                ids, copies, starts, counts = b.column(0).to_pylist(), [], [], []
                for i, data in zip(ids, tok.encode(C.raw_texts(b)), strict=True):
                    seen, last = (seen + 1, last) if i == last and last is not object else (0, i)
                    f.write(data)
                    f.write(end)
                    n = len(data) // tok.width + 1
                    copies.append(seen)
                    starts.append(offset)
                    counts.append(n)
                    offset += n
                yield C.batches({"doc_id": ids, "copy": copies, "shard": [shard] * len(ids), "offset": starts, "n_tokens": counts}, ENTRY)
        fs.move(tmp, f"{root}/{name}")

    return run


def _keys(b: pa.RecordBatch):
    null = np.array(b.column("doc_id").is_null())
    return b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("copy").to_numpy(zero_copy_only=False), null


def _build_parts(path: str, parts: int):
    def run(it):
        """All rows of a few parts, sorted by part: each part's file is written as it ends."""
        held, at = [], None

        def close():
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            put(path, [index_bytes(*_keys(t), *(t.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "offset", "n_tokens")))], f"index-{at:05d}.mph")

        for b in it:
            part = b.column("part").to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                if p != at:
                    close()
                    held, at = [], p
                held.append(b.filter(pa.array(part == p)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([1 if held else 0], pa.int64())], names=["n"])

    return run


def _look_up(path: str):
    def run(it):
        at, index = None, None
        fs, root = opened(path)
        for b in it:
            part = b.column("part").to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                if p != at:
                    with fs.open_input_file(f"{root}/index-{p:05d}.mph") as f:
                        index, at = IndexPart(f.read()), p
                c = b.filter(pa.array(part == p))
                found, shard, offset, length = index.get(*_keys(c))
                if not found.all():
                    raise ValueError("a written key is missing from the index")
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("copy"), pa.array(shard.astype(np.int32)), pa.array(offset), pa.array(length)], schema=ENTRY)

    return run


READ = pa.schema([*ENTRY, ("ids_crc32", pa.int64()), ("last_id", pa.int64())])


def _read_shards(path: str, width: int):
    def run(it):
        fs, root = opened(path)
        at, f = None, None
        for b in it:
            crc, tail = [], []
            for shard, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                if shard != at:
                    f, at = fs.open_input_file(f"{root}/shard-{shard:05d}.ids"), shard
                ids = np.frombuffer(f.read_at(n * width, offset * width), f"<u{width}")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                tail.append(int(ids[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crc, pa.int64()), pa.array(tail, pa.int64())], schema=READ)

    return run


def _part(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int"))


def _numbered(raw: DataFrame) -> DataFrame:
    """Entries whose copy numbers run on where a doc_id's rows fill more than one shard."""
    per = raw.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    more = per.withColumn("before", before).where("before > 0").select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), "before")
    out = raw.join(more, raw["doc_id"].eqNullSafe(F.col("_id")) & (F.col("shard") == F.col("_shard")), "left")
    return out.select("doc_id", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "offset", "n_tokens")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode, write shards, index and manifest under ``path``; returns the entries (doc_id, copy,
    shard, offset, n_tokens) as a table in the shared folder.

    Documents are range-partitioned by doc_id and text hash (a shuffle of the texts, no more than that)
    and each task streams its range to one shard; there are as many as the session's shuffle
    partitions, more where shards would be too long. An empty input gives no shard and no index part.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    rows = C.id_text(docs)
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    raw = C.written(rows.mapInArrow(_write_shards(path, tokenizer, end_id), ENTRY_SQL), "shards")
    entries = C.written(_numbered(raw), "entries")
    n = entries.count()
    parts = -(-n // PART_KEYS) or 1
    build = _part(entries, parts).repartition(min(parts, shards), "part").sortWithinPartitions("part")
    build.mapInArrow(_build_parts(path, parts), "n long").agg(F.sum("n")).collect()
    put(path, [json.dumps({"keys": n, "parts": parts, "width": C.token_cache(tokenizer).width, "end_id": end_id}).encode()], "manifest.json")
    return entries


def read(keys: DataFrame, path: str) -> DataFrame:
    """Keys (doc_id, copy) through the index to their payloads: adds shard, offset, n_tokens,
    ids_crc32 (over little-endian unsigned 32-bit ids) and last_id."""
    about = Reader(path).manifest
    found = _part(keys.select("doc_id", "copy"), about["parts"]).repartition("part").sortWithinPartitions("part").mapInArrow(_look_up(path), ENTRY_SQL)
    return found.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(_read_shards(path, about["width"]), ENTRY_SQL + ", ids_crc32 long, last_id long")


def starts(entries: DataFrame) -> DataFrame:
    """Each shard's first position in the whole sequence (one row a shard)."""
    total = entries.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    return total.select("shard", (F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("_base")).fillna(0, ["_base"])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and read every document back through the index.

    Returns a row a document: doc_id, copy, shard, offset, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32, last_id. Texts are encoded whole, of any length. Null and empty texts hold the end id only; nulls
    in doc_id sort first; repeated doc_ids get copy numbers; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or C.fresh(spark, "tokens", keep=True)
    entries = write(docs, path, tokenizer, end_id)
    back = read(entries, path)
    return back.join(starts(entries), "shard").withColumn("start", F.col("_base") + F.col("offset")).drop("_base")


def query(spark, sf_dir: str) -> DataFrame:
    """op5_token_files."""
    import public_tokenizers

    out = token_files(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32", "copy", "shard")
