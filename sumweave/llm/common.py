"""What the corpus operators share: session set-up, shared tables, word and shingle hashing, ids.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D, so ``bytes.split()`` yields them;
``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import array
import contextlib
import glob
import io
import itertools
import json
import os
import re
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumweave.sources import shared

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Entries a worker's caches hold before they start afresh (a memory bound; results don't depend on it).
CACHE = 1_000_000
#: Rows and bytes to an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> str:
    """The shared folder. Also has workers find this package, and has rows go to them in batches that
    are bounded in rows and bytes (a session's own smaller bounds stay)."""
    sc = spark.sparkContext
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    base = shared.folder(spark)
    if sc.master.startswith("local"):  # workers on this machine
        sc.environment["PYTHONPATH"] = ROOT
    elif sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name in glob.glob("sumweave/**/*.py", root_dir=ROOT, recursive=True):
                z.write(f"{ROOT}/{name}", name)
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/sumweave-{sc.applicationId}.zip") as f:
            f.write(data.getvalue())
        sc.addPyFile(f"{base}/sumweave-{sc.applicationId}.zip")
    return base


_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []


def fresh(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; inside ``scratch`` it goes with it, unless it is to be kept."""
    prepare(spark)
    path = shared.fresh(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables written within: for steps whose result is itself written (with
    ``keep``) by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        paths = _SCRATCH.pop()
        conf = spark._jsc.hadoopConfiguration()
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """The rows as a table in the shared folder: it cuts lineage and outlives lost executors."""
    path = fresh(df.sparkSession, name, keep)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as bigint, text, and further columns by name; others are left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(col.type)
    return [x or b"" for x in col.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(how many words each of the texts has, all words in a row as places in the distinct ones, the
    distinct ones), of texts without nulls with A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n, words = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty words
    if not real.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        words = words.filter(pa.array(real))
    words = words.dictionary_encode()
    distinct = words.dictionary
    distinct = distinct.view(pa.large_binary() if pa.types.is_large_string(distinct.type) else pa.binary())
    return n, words.indices.to_numpy(), distinct.to_numpy(zero_copy_only=False).tolist()


class WordHashes(dict):
    """Word -> 64-bit hash, computed on first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of n words; for fewer words, one for the whole sequence."""
    if not len(words):
        return words
    if len(words) < n:
        h = np.uint64(len(words)) + np.zeros(1, np.uint64)
        for w in words:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
        return h
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    return mix(h)


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


#: A word of Latin letters with at most one mark behind it: one or two pre-tokens.
PLAIN = re.compile(r"([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:]?)")


def byte_letters() -> list[str]:
    """The letter byte-level models write for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class TokenCache:
    """Word -> its token ids as little-endian uint16 or uint32 bytes.

    White space always separates pre-tokens in the tokenizer used here, so a text's ids are the
    words' ids in a row. A new word of Latin letters is one pre-token and goes straight to the
    library's BPE model; any others are encoded many at a time, joined by a special token that
    marks their borders. At ``limit`` words the later-learnt ones (rare words, mostly) are forgotten.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>", limit: int = CACHE):
        from tokenizers import Tokenizer

        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.sep, self.sep_id = separator, self.tok.token_to_id(separator)
        self.letters = dict(enumerate(byte_letters()))
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.direct = kind["model"].get("end_of_word_suffix") == "</w>" and any(x["type"] == "Lowercase" for x in (kind["normalizer"] or {}).get("normalizers", []))

    def learn(self, words: set[bytes]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words = dict(itertools.islice(self.words.items(), self.limit // 3))
        one, marks, other = self.tok.model.tokenize, {}, []
        for raw in words:
            w = raw.decode("utf-8", "replace")
            if self.direct and (m := PLAIN.fullmatch(w)):
                body, mark = m[1].lower(), m[2]
                body = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
                ids = [x.id for x in one(body)]
                if mark:
                    if mark not in marks:
                        marks[mark] = [x.id for x in one(mark)]
                    ids += marks[mark]
                self.words[raw] = array.array("H" if self.width == 2 else "I", ids).tobytes()
            else:
                other.append((raw, w))
        plain = [x for x in other if "<|" not in x[1]]
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            ids = np.array(self.tok.encode(self.sep.join(w for _, w in part) + self.sep, add_special_tokens=False).ids, self.dtype)
            data, k, start = ids.tobytes(), self.width, 0
            for (raw, _), e in zip(part, np.flatnonzero(ids == self.sep_id).tolist(), strict=True):
                self.words[raw] = data[start * k : e * k]
                start = e + 1
        for raw, w in other:
            if "<|" in w:
                self.words[raw] = np.array(self.tok.encode(w, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as bytes."""
        out: list[bytes] = []
        for a in range(0, len(texts), 64):
            split = [t.split() for t in texts[a : a + 64]]
            out += self.encode_split(split, set().union(*split))
        return out

    def encode_split(self, split: list[list[bytes]], seen: set[bytes]) -> list[bytes]:
        """The same for texts cut into words, ``seen`` being all of these."""
        if len(self.words) + len(seen) > self.limit:
            self.words = dict(itertools.islice(self.words.items(), self.limit // 3))
        if new := seen.difference(self.words):
            self.learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, w)) for w in split]


_TOKENS: dict[str, TokenCache] = {}


def forget() -> None:
    """Give up this worker's caches, for passes that need their memory for something else."""
    _WORDS.clear()
    _TOKENS.clear()


def token_cache(path: str, limit: int = CACHE) -> TokenCache:
    """The worker's cache for a tokenizer file; it lives as long as the worker."""
    if path not in _TOKENS or _TOKENS[path].limit != limit:
        _TOKENS[path] = TokenCache(path, limit=limit)
    return _TOKENS[path]
