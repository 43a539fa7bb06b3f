import re

import pytest

from sumweave.llm import near_dedup as N
from tests.llm.helpers import docs_of, edited, empty_docs, odd_docs, prose, rng


def brute(rows, words, percent):
    def sh(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [sh(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if a and 100 * a >= percent * b:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        best[r] = min(d, best.get(r, d))
    return sorted((d, len(sets[i]), best[find(i)], d == best[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert got(N.near_groups(docs, 3, 85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("block", [N.BLOCK, 700])
def test_large_group_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "TILE", 16 if block == 700 else N.TILE)
    rnd = rng(3)
    base, passage = prose(rnd, 90), prose(rnd, 30)
    texts = [edited(rnd, base, rnd.randrange(4)) for _ in range(70)]
    texts += [f"{passage} {prose(rnd, 40)}" for _ in range(60)] + [passage] * 30 + [prose(rnd, rnd.randrange(1, 9)) for _ in range(40)]
    long = prose(rnd, 900, 5000)
    texts += [edited(rnd, long, rnd.randrange(40)) for _ in range(25)]
    rnd.shuffle(texts)
    assert got(N.near_groups(docs_of(spark, texts), 3, 85)) == brute(list(enumerate(texts)), 3, 85)


def test_all_sets_whole(spark):
    """k=None: the search is exact for long texts too."""
    rnd = rng(9)
    base = [prose(rnd, 300, 2000) for _ in range(4)]
    texts = [edited(rnd, b, rnd.randrange(16)) for b in base for _ in range(12)]
    assert got(N.near_groups(docs_of(spark, texts), 3, 85, k=None)) == brute(list(enumerate(texts)), 3, 85)


def test_many_null_ids(spark):
    rnd = rng(10)
    base = prose(rnd, 80)
    rows = [(None, edited(rnd, base, 1), "en", "s", 1) for _ in range(80)] * 2 + [(None, base, "en", "s", 1)] * 60 + [(3, base, "en", "s", 1), (9, prose(rnd, 50), "en", "s", 1)]
    out = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 3, 85).collect()
    assert len(out) == len(rows) and {r["component_id"] for r in out if r["doc_id"] != 9} == {3} and sum(r["kept"] for r in out) == 2


def test_rows_told_by_id_and_text(spark):
    a, b = prose(rng(1), 40), prose(rng(2), 40)
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, b + " x", "en", "s", 1)]
    got = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (5, b)]


def test_union_shared():
    import numpy as np

    rnd = np.random.default_rng(3)
    for k in (4, 32):
        a, b = ([np.unique(rnd.integers(0, 60, rnd.integers(0, 40)).astype(np.uint64))[:k] for _ in range(50)] for _ in range(2))
        want = [len(set(np.union1d(x, y)[:k].tolist()) & set(x.tolist()) & set(y.tolist())) for x, y in zip(a, b, strict=True)]
        assert N.union_shared(a, b, k).tolist() == want


def test_odd_and_empty(spark):
    rows = sorted(map(tuple, N.near_groups(odd_docs(spark), 3, 85).select("doc_id", "component_id", "kept").collect()), key=str)
    assert len(rows) == 11
    assert (5, 5, True) in rows and (None, 5, False) in rows and (None, None, True) in rows and (4, 4, True) in rows
    assert N.near_groups(empty_docs(spark)).count() == 0
    assert N.near_dedup(odd_docs(spark)).columns == odd_docs(spark).columns
    assert N.near_dedup(docs_of(spark, ["a b c d e f g", "a b c d e f g", None, ""])).count() == 3


def test_estimate():
    import numpy as np

    a, b = np.arange(0, 100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    assert N.union_estimate(a, a) == 1 and abs(N.union_estimate(a, b) - 22 / 32) < 1e-9
