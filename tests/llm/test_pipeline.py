"""The pipeline's stages one by one, each against the plain version of what it decides."""

import collections
import re

import corpus_pipeline
from sumweave.llm import decontaminate, mixing, quality
from tests.llm.helpers import DOCS, empty_docs, odd_docs, prose, rng
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_token_files import brute as brute_tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    step = lambda name: spark.createDataFrame(stages[name](spark, docs, SF).collect(), docs.schema)

    kept = step("quality rules")
    want = {r[0] for r in quality.verdicts(docs).where("kept").select("doc_id").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == want
    docs = kept

    single = step("near duplicates")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == [d for d, _, _, k in brute_groups(rows, 5, 80) if k]
    docs = single

    clean = step("decontamination")
    bad = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    docs = clean

    mixture = step("source mix")
    uses = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixture.columns == columns and collections.Counter(r["doc_id"] for r in mixture.collect()) == uses
    docs = mixture

    out = stages["token files"](spark, docs, SF).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == brute_tokens(rows)


def test_odd(spark):
    # too few or repeated words; equal rows and the copy without an id go; nothing leaks; one source: all once
    rows = {"quality rules": 0, "near duplicates": 9, "decontamination": 11, "source mix": 11, "token files": 11}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs(spark), SF).count() == rows[name], name
        assert stage(spark, empty_docs(spark), SF).count() == 0, name


def test_quality_stage_removes_lines(spark):
    rnd = rng(12)
    often, seldom = "Shared line 17 of this host", "a line that only some hold"
    texts = [f"{often}\n{prose(rnd, 60, 5000)}\n\n{seldom if i < 5 else f'own {prose(rnd, 2, 5000)}'}\n {often.upper()} " for i in range(130)] + [f"{often}\n" * 40 + prose(rnd, 20, 5000), "too short"]
    rows = [(500 - i, t, "en", "h", len(t)) for i, t in enumerate(texts)] + [(1000 + i, t, "en", "other", len(t)) for i, t in enumerate(texts[:20])]
    rows += [(450, "rejected text with a kept doc_id", "en", "h", 32), (451, prose(rnd, 70, 5000), "en", "h", 9)]
    normal = lambda line: re.sub("[0-9]", "0", " ".join(line.lower().split()))
    holders = collections.defaultdict(set)
    for d, t, _, host, _ in rows:
        for line in t.split("\n"):
            holders[host, normal(line)].add((t, d))
    want = []
    for d, t, lang, host, n in rows:
        lines, words = t.split("\n"), t.split()
        out = [x for x in lines if not x.split() or len({h for h, _ in holders[host, normal(x)]}) <= quality.LINE_DOCS or min(i for _, i in holders[host, normal(x)]) == d]
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) >= 50 and 2 * len(again) <= len(words) and len(" ".join(out).split()) >= 0.3 * len(words):
            new = "\n".join(out)
            want.append((d, new, lang, host, n if new == t else len(new)))
    got = dict(corpus_pipeline.STAGES)["quality rules"](spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(often not in t for _, t, *_ in want) > 100
