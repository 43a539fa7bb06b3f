import zlib

import numpy as np
import public_tokenizers as P
import pytest

from sumweave.llm import token_files as T
from tests.llm.helpers import empty_docs, odd_docs

PATH = P.path("word_bpe_49k.json")


def brute(rows):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r[0], r[1]) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, T.token_files(docs, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(rows)


def test_odd(spark):
    got = T.token_files(odd_docs(spark), PATH).collect()
    assert len(got) == 11 and sum(r["n_tokens"] == 1 for r in got) == 4
    assert sorted(r["copy"] for r in got if r["doc_id"] == 5) == [0, 1, 2] and sorted(r["copy"] for r in got if r["doc_id"] is None) == [0, 1]
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in ordered] == sorted(r["doc_id"] is not None for r in ordered)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert all(r["last_id"] == 2 for r in got)
    assert T.token_files(empty_docs(spark), PATH).count() == 0


def test_perfect_hash():
    n = 5000
    ids, copy, null = np.arange(n) * 7 - 11, np.arange(n) % 2, np.zeros(n, bool)
    part = T.IndexPart(T.index_bytes(ids, copy, null, ids % 5 + 2, ids + 100, ids + 50))
    found, shard, offset, length = part.get(ids, copy, null)
    assert found.all() and (offset == ids + 100).all() and (length == ids + 50).all() and (shard == ids % 5 + 2).all()
    assert sorted(part.ph.slots(ids, copy, null).tolist()) == list(range(n))
    other = part.get(ids + 1_000_000, copy, null)[0]
    assert other.mean() < 0.001
    with pytest.raises(ValueError):
        T.index_bytes(*[np.zeros(2, np.int64)] * 2, np.zeros(2, bool), *[np.zeros(2, np.int64)] * 3)


def test_reader(spark, tmp_path):
    """Single keys through manifest, index and payload; absent keys; nulls; ids that fill several shards."""
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(PATH), f"file://{tmp_path}/set"
    rows = [(i, f"text {i} of the set") for i in range(60)] + [(7, f"another {k}") for k in range(80)] + [(None, f"no id {k}") for k in range(80)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entries = T.write(docs, path, PATH, 2, shards=6).collect()
    r = T.Reader(path)
    assert r.manifest["keys"] == len(rows) == len({(e["doc_id"], e["copy"]) for e in entries})
    assert len({e["shard"] for e in entries if e["doc_id"] == 7}) > 1 and len({e["shard"] for e in entries if e["doc_id"] is None}) > 1
    want = {d: sorted([*tok.encode(t or "", add_special_tokens=False).ids, 2] for x, t in rows if x == d) for d in (None, 7, 8, 99)}
    for d, texts in want.items():
        assert sorted(r.get(d, k).tolist() for k in range(len(texts))) == texts and r.get(d, len(texts)) is None
    assert sum(r.get(10**9 + k) is not None for k in range(300)) == 0
    T.write(docs.limit(0), path + "0", PATH, 2)
    assert T.Reader(path + "0").get(1) is None
