"""Each operator against a plain version, and on odd and empty tables."""

import collections
import hashlib
import math
import re
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumweave.llm import attention, common, components, decontaminate, licenses, lm_score, mixing, private_data, quality, registry, token_counts, url_filter
from tests.llm.helpers import DOCS, docs_of, edited, empty_docs, odd_docs, prose, rng

SF = "/root/testdata/sf0.001"
RANKS, BYTE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    res = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    want = sorted((tuple(r) for r in res.fetchall()), key=str)
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == want


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rnd = rng(5)
    counter = token_counts.Counter(BYTE)
    alphabet = "ab  'stré\n\n\t1,.5ll d"
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400)))
        tree = token_counts.Tree(text, counter)
        assert tree.total == n(text)
        for _ in range(6):
            a = rnd.randrange(0, len(text) + 2)
            b, new = a + rnd.choice([0, 0, 1, 5, 300]), "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 900])))
            tree.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == n(text)
    assert token_counts.Tree("a <|endoftext|> b", counter).total == n("a <|endoftext|> b") == 9
    tree = token_counts.Tree("end " * 50_000, counter)
    tree.edit(100_000, 100_004, "<|endoftext|>")  # local work in a long text
    assert tree.total == n(tree.text) and tree.recut < 3 * token_counts.LEAF * 4
    rows = token_counts.count_tokens(docs, F.expr(token_counts.SCRIPT), BYTE).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["n_tokens"] == n(texts[r["doc_id"]]) for r in rows)
    assert sum(r["recut_chars"] for r in rows) < 0.2 * sum(map(len, texts.values()))
    assert len(token_counts.count_tokens(odd_docs(spark), F.expr(token_counts.SCRIPT), BYTE).collect()) == 11
    assert token_counts.count_tokens(empty_docs(spark), F.expr(token_counts.SCRIPT), BYTE).count() == 0
    table = spark.createDataFrame([(1, 2, 0, 1, "zz"), (1, 1, 0, 3, "")], "doc_id long, at int, start int, end int, new string")
    got = token_counts.count_tokens(token_counts.with_edits(docs_of(spark, ["abc def", "abc def"]), table), F.col("edits"), BYTE)
    assert sorted((r["doc_id"], r["n_edits"], r["n_chars_edited"]) for r in got.collect()) == [(0, 0, 7), (1, 2, 5)]


def plain_private(text):
    """Base counts and hash by the expressions as they stand."""
    spans = []
    for k in private_data.KINDS:
        spans += [(k, m.start(), m.end()) for m in private_data.BASE[k].finditer(text or "") if private_data.passes(k, m[0])]
    return *(sum(k == x for x, _, _ in spans) for k in private_data.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_private_base():
    rnd = rng(12)
    for alphabet in ("a.@-_ ", "ab@.c@%é\n", "0123.9 -", "1+2. ()-", "4 -0+.@a"):
        for _ in range(400):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60)))
            spans = private_data.base_spans(t)
            got = *(sum(k == x for x, _, _ in spans) for k in range(4)), hashlib.sha256(",".join(f"{private_data.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            assert got == plain_private(t), t
            seeds = private_data.seed_spans(t)
            assert seeds[: len(spans)] == spans
            assert not any(a < z and x < b for k, a, b in private_data.candidates(t, seeds) for _, x, z in seeds)
    for long in ("7" * 500_000, "a" * 500_000 + " at", "a" * 500_000 + "@b", "1.2." * 100_000, "x@y " * 100_000, "a1" * 250_000, "1 " * 250_000):  # each read in one pass
        seeds = private_data.seed_spans(long)
        assert not [s for s in seeds if s[0] != 1] and private_data.candidates(long, seeds) is not None


def test_private_candidates():
    t = 'at 2001:db8::7 or 020 7946 0958 or 4000 0012 3456 789 or jörg@höhe.example or key="p4ss-w0rd99"; plain words 3.0 and 12'
    got = {(private_data.ALL[k], t[a:b]) for k, a, b in private_data.candidates(t, [])}
    assert {("ip", "2001:db8::7"), ("phone", "020 7946 0958"), ("card", "4000 0012 3456 789"), ("email", "jörg@höhe.example"), ("secret", "p4ss-w0rd99")} <= got
    assert not any(x in ("12", "3.0") for _, x in got)
    t = f"ghp_{'a1B2' * 9} and {'0123456789' * 4} x AKIA{'ABCD' * 4}"
    assert [k for k, _, _ in private_data.seed_spans(t)] == [4, 4, 4]


def test_private_data(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_private_data"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert (*(g[f"n_{k}"] for k in private_data.KINDS), g["base_sha256"]) == plain_private(r["text"])
    t = "x 1.2.3.999 10.0.0.1.7 +1 (456) 555-2186 4111 1111-1111 1111 a@b.c@d.e"
    assert private_data.base_spans(t) == [(0, t.index("a@"), t.index("@d")), (1, t.index("10."), t.index(".7"))]
    assert [(k, a) for k, a, _ in private_data.base_spans("10.0.0.1.7 9.9.9.999 4111 1111 1111 1111 4111 1111 1111 1112")] == [(1, 0)]
    assert private_data.passes("card", "4111 1111 1111 1111") and not private_data.passes("card", "4111 1111 1111 1112")
    cards = ["4111 1111 1111 1111", "4012888888881881", "5105105105105100", "4222222222222220000".replace("0000", "2")[:16], "4000001234567899"]
    cards = [c for c in cards if private_data.passes("card", c)]
    texts = [f"filler {i} please pay with card number {c} now" for i, c in enumerate(cards)]
    texts += ["so pay with card number 4000 0012 3456 789 today", "ring card 12345678 bell", "lonely 1234 5678 1234 5678 digits", None]
    texts += [f"m{i}: set token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" here" for i in range(4)] + ['v9: set TOKEN = "Zx-77-unheard-of" here', 'a note = "Zx-78-innocent" here']
    texts += [f"the server answers at address {k}.9.8.7 only" for k in range(4)] + ["the server answers at address 2001:db8::7 only"]
    assert len(cards) >= 3
    got = {r["doc_id"]: r for r in private_data.find(docs_of(spark, texts)).collect()}
    assert sum(s["seed"] for r in got.values() for s in r["spans"]) == sum(len(private_data.seed_spans(t or "")) for t in texts)
    added = {(private_data.ALL[s["kind"]], texts[d][s["start"] : s["stop"]]) for d, r in got.items() for s in r["spans"] if not s["seed"]}
    assert added == {("card", "4000 0012 3456 789"), ("secret", "Zx-77-unheard-of"), ("ip", "2001:db8::7")}  # in no known form: found by their company alone
    assert sum(r["n_found"] for r in got.values()) == 3 and sum(r["n_secret"] for r in got.values()) == 4
    for r in got.values():
        assert [tuple(s)[:3] for s in r["spans"]] == sorted(tuple(s)[:3] for s in r["spans"])
    assert len(private_data.find(odd_docs(spark)).collect()) == 11 and private_data.find(empty_docs(spark)).count() == 0


def test_private_table(spark):
    """The patterns of the test table itself find credentials beyond the known forms."""
    out = registry.QUERIES["op3_private_data"](spark, "/root/testdata/sf0.1")
    n = out.selectExpr("sum(n_secret)", "sum(n_found)", "sum(n_spans - n_secret - n_found - n_email - n_ip - n_card - n_phone)").collect()[0]
    assert n[0] > 50 and n[1] > 0 and n[2] == 0


def plain_score(edges, rounds=private_data.ROUNDS):
    """The graph's scores in plain Python."""
    seeds = {(k, i) for k, _, i, s in edges if s}
    score = {(k, i): float((k, i) in seeds) for k, _, i, _ in edges}
    around, total = collections.defaultdict(set), collections.defaultdict(set)
    for k, p, i, s in edges:
        around[k, p].add(i)
        if s:
            total[p].add((k, i))
    for _ in range(rounds):
        conf = {}
        for (k, p), inst in around.items():
            x = sum(score[k, i] for i in inst)
            other = sum(kk != k for kk, _ in total[p])
            conf[k, p] = x / (x + other + private_data.UNLABELLED * (len(inst) - x) + 1) if x >= private_data.SEEDS else 0
        new = {}
        for k, i in score:
            good = [conf[kk, p] for (kk, p), inst in around.items() if kk == k and i in inst and conf[kk, p] >= private_data.CONFIDENCE]
            new[k, i] = 1.0 if (k, i) in seeds else 1 - math.prod(1 - c for c in good)
        score = new
    return {x: s for x, s in score.items() if s >= private_data.CONFIDENCE and x not in seeds}


def test_private_bootstrap(spark):
    rnd = rng(31)
    fixed = [(2, 1, i, 1) for i in range(9)] + [(2, 1, 100, 0), (2, 2, 100, 0), (2, 2, 101, 0), (2, 3, 0, 1), (2, 3, 102, 0), (2, 3, 103, 0)]
    mixed = [(k, 4 * k + rnd.randrange(4) if rnd.random() < 0.9 else rnd.randrange(12), i, int(i % 7 > 0)) for i in range(90) for k in [i % 3] for _ in range(3)]
    for edges in (fixed, mixed):
        got = private_data.score(spark.createDataFrame(edges, "kind int, pattern long, instance long, seed int"))
        want = plain_score(edges)
        assert {(r[0], r[1]): round(r[2], 9) for r in got.collect()} == {x: round(v, 9) for x, v in want.items()} and want


def test_quality(spark):
    line = "this very line stands in a great many documents of the host"
    rnd = rng(2)
    texts = [f"{line}\n{prose(rnd, 60, 5000)}" for _ in range(30)] + [f"{line}\n" * 6 + "and a few more words"] + [f"{line} a b\n{line} 7\n{line} 8"] * 2
    rows = [(i, t, "en", "h", 1) for i, t in enumerate(texts)]
    v = {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(rows, DOCS), line_docs=10).collect()}
    assert v[0]["removed_words"] == 0 and v[1]["removed_words"] == 12 and v[5]["kept"] and v[30]["removed_words"] == 72 and not v[30]["kept"]
    assert v[30]["n_dup_lines"] == 5 and v[30]["n_repeat_words"] == 72
    got = {r["doc_id"]: r for r in quality.verdicts(odd_docs(spark)).where("doc_id is not null").collect()}
    assert quality.verdicts(odd_docs(spark)).count() == 11 and got[1]["base_failed"] and got[6]["n_words"] == 60_000
    assert quality.verdicts(empty_docs(spark)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in quality.cleaned(spark.createDataFrame(rows, DOCS), line_docs=10).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1].split("\n")[1] and clean[30] == "and a few more words"
    again = quality.cleaned(spark.createDataFrame(rows + [rows[1], (50, None, "en", "h", 1), (51, line, "en", "h", 1), (52, f" \n{line}\n\nz", "en", None, 1)], DOCS), line_docs=10)
    many = collections.Counter((r["doc_id"], r["text"]) for r in again.collect())
    assert many[1, clean[1]] == 2 and many[50, None] == many[51, ""] == many[52, f" \n{line}\n\nz"] == 1 and sum(many.values()) == len(rows) + 4
    assert quality.cleaned(odd_docs(spark)).count() == 11 and quality.cleaned(empty_docs(spark)).count() == 0
    assert quality.filtered(odd_docs(spark)).columns == odd_docs(spark).columns


def test_mixing(spark, docs):
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    for t in (None, "", " a", "a b ", "\n", "é\x0bb"):
        assert spark.createDataFrame([(t,)], "t string").select(mixing.n_words(F.col("t"))).collect()[0][0] == words(t)
    rnd = rng(4)
    sizes = {"a": 900, "b": 60, "c": 12}
    rows = [(i, prose(rnd, rnd.randrange(5, 30)), "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, DOCS)
    total = collections.Counter()
    for r in rows:
        total[r[3]] += words(r[1])
    whole = sum(total.values())
    for how in ({"target_entropy": 0.8, "max_repeats": None}, {"target_entropy": 1.0, "max_repeats": 3.0}):
        got = mixing.mix(df, **how).collect()
        used = collections.Counter()
        for r in got:
            used[r["source"]] += r["n_tokens"]
        assert sum(used.values()) <= whole and sum(used.values()) > 0.97 * whole
        if how["max_repeats"]:
            assert 2.7 <= used["c"] / total["c"] <= 3.0
        else:
            w = [x / sum(used.values()) for x in used.values()]
            assert abs(-sum(x * math.log(x) for x in w) / math.log(3) - 0.8) < 0.02
        uses = collections.Counter((r["doc_id"], r["epoch"]) for r in got)
        assert max(uses.values()) == 1
        times = collections.Counter(r["doc_id"] for r in got)
        for s in sizes:
            own = [times[r[0]] for r in rows if r[3] == s]
            assert max(own) - min(own) <= 1
    assert mixing.mix(odd_docs(spark)).count() == 11 and mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == mixing.mix(df).count()
    same = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 3 + [(2, "x y", "en", "s", 7), (None, "n n", "en", None, 7), (None, "n n", "fr", None, 8)], DOCS)
    for budget in (4, 8, 16, 33, 60):
        used, got = mixing.mix(same, budget=budget, max_repeats=None).collect(), mixing.mixed(same, budget=budget, max_repeats=None).collect()
        count = lambda x: collections.Counter((r["doc_id"], r["source"]) for r in x)
        assert count(used) == count(got) and sum(words(r["text"]) for r in got) <= budget


def test_alpha():
    """The exponent against a plain bisection over shares of very unequal sources."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    p = [0.7, 0.2, 0.06, 0.03, 0.01]
    df = spark.createDataFrame([(x,) for x in p], "p double")

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.8 * math.log(5) else (low, mid)
    assert abs(mixing.find_alpha(df, 0.8, None) - low) < 1e-6
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p[-1] ** (mid - 1) / sum(x**mid for x in p) > 3 else (low, mid)
    assert abs(mixing.find_alpha(df, None, 3.0) - high) < 1e-6


def test_licenses(spark):
    t = licenses.TEMPLATES
    rnd = rng(8)
    texts = [f"{prose(rnd, 200)}\n{t['MIT notice']}\n{prose(rnd, 50)}", f"{t['MIT']} {t['MIT']} {t['MIT']}", "all kinds of rights were reserved", f"x {t['GPL-3.0'].upper()} y", edited(rnd, t["Apache-2.0 notice"], 6), prose(rnd, 500)]
    got = collections.defaultdict(set)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])
        assert r["coverage"] >= licenses.COVERAGE and r["first_word"] <= r["last_word"]
    assert "MIT notice" in got[0] and "MIT" in got[1] and not got[2] and "GPL-3.0" in got[3] and "Apache-2.0 notice" in got[4] and not got[5]
    a, b = list("xabcyd"), list("abcd")
    assert licenses.patience(a, b) == [(1, 0), (2, 1), (3, 2), (5, 3)] and licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert licenses.scan(odd_docs(spark)).count() == 0 and licenses.scan(empty_docs(spark)).count() == 0


def test_license_insertions(spark):
    """Whole texts against plain patience alignment: words put in between take nothing away."""
    rnd = rng(18)
    t = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) >= licenses.LONG}
    norm = lambda s: [w for x in s.encode().split() if (w := licenses.normal(x))]
    texts = []
    for name in t:
        w = t[name].split()
        for gaps in (1, 3, 12):
            at = sorted(rnd.sample(range(len(w)), gaps))
            texts.append(" ".join(x for a, b in zip([0, *at], [*at, len(w)], strict=True) for x in (*w[a:b], *prose(rnd, 60).split())))
        texts += [edited(rnd, t[name], n) for n in (3, len(w) // 4, len(w) // 2)] + [" ".join(rnd.sample(w, len(w)))]
    got = {(r["doc_id"], r["license"]): r["coverage"] for r in licenses.scan(docs_of(spark, texts)).collect()}
    hits = 0
    for d, text in enumerate(texts):
        for name, template in t.items():
            words = norm(template)
            whole = len(licenses.patience([x for x in norm(text) if x in set(words)], words)) / len(words)
            assert whole < licenses.COVERAGE or got[d, name] >= whole, (d, name)
            hits += whole >= licenses.COVERAGE
    assert hits >= 9


def test_alignment():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = rnd.integers(0, 5, rnd.integers(1, 12)), rnd.integers(0, 5, rnd.integers(1, 25))
        got, first, last = decontaminate.smith_waterman(a, b)
        assert got == plain(a, b) and (not got or plain(a, b[first : last + 1]) == got)


def test_decontamination(spark):
    rnd = rng(6)
    items = [(i, prose(rnd, 30, 3000)) for i in range(20)] + [(90, None), (91, "of the"), (92, "")]
    texts = [f"{prose(rnd, 40)} {items[i][1]} {prose(rnd, 40)}" for i in range(10)] + [f"{prose(rnd, 40)} {edited(rnd, items[i][1], 6)}" for i in range(10, 15)] + [prose(rnd, 300, 3000) for _ in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(i, i) for i in range(15)} and got[3, 3]["score"] == 1 and got[3, 3]["first_word"] == 40 and got[3, 3]["last_word"] == 69
    assert decontaminate.decontaminated(docs_of(spark, texts), bench).count() == 10
    short = spark.createDataFrame([(1, "w7 w8"), (2, "Zq"), (3, "zq w7"), (4, " ")], "item_id long, text string")
    found = decontaminate.leaks(docs_of(spark, ["a w7 w8 w8", "w8 w7", "zQ", "x zq w7 zq", "", None]), short).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in found) == [(0, 1, 1), (2, 2, 0), (3, 2, 1), (3, 3, 1)]
    assert decontaminate.decontaminated(docs_of(spark, ["zq", "a w7 w8"]), short).count() == 2
    assert decontaminate.leaks(odd_docs(spark), bench).count() == 0 and decontaminate.leaks(empty_docs(spark), bench).count() == 0
    assert decontaminate.decontaminated(odd_docs(spark), bench.limit(0)).count() == 11


def test_decontamination_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEDS", 40)
    rnd = rng(9)
    items = [(i, prose(rnd, 20, 3000)) for i in range(7)]
    texts = [t for _, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r[0], r[2]) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()) == [(i, i) for i in range(7)]


def test_decontamination_hot(spark):
    rnd = rng(14)
    items = [(i, prose(rnd, 24, 3000)) for i in range(2)]
    texts = [items[i % 2][1] for i in range(60)]
    for i in range(120):  # each edited copy keeps one or two stretches of an item that all the others hold
        w, a = items[i % 2][1].split(), i // 2 % 12
        texts.append(" ".join(x if a <= k < a + 12 or k % 2 else f"e{i}" for k, x in enumerate(w)))
    item_words = [np.array([hash(x) for x in t.split()]) for _, t in items]
    want = {(d, i) for d, t in enumerate(texts) for i in range(2) if decontaminate.smith_waterman(item_words[i], np.array([hash(x) for x in t.split()]))[0] >= 24}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) >= 180
    alone = []  # a lone intact seed, whichever it is
    for a in range(22):
        alone.append(" ".join(x if a <= k < a + 3 or (k - a) % 3 else "zz" for k, x in enumerate(items[0][1].split())))
    best = [decontaminate.smith_waterman(item_words[0], np.array([hash(x) for x in t.split()]))[0] for t in alone]
    got = {r["doc_id"] for r in decontaminate.leaks(docs_of(spark, alone), spark.createDataFrame(items[:1], "item_id long, text string")).collect()}
    assert got == {d for d, x in enumerate(best) if x >= 24} and len(got) > 10


def test_decontamination_recall(spark):
    """Edited copies against Smith-Waterman over all pairs: at least 0.9 of what reaches the score is found, nothing else."""
    rnd = rng(23)
    items = [(i, prose(rnd, rnd.randrange(8, 40), 3000)) for i in range(12)]
    texts = []
    for i in range(240):
        w = items[i % 12][1].split()
        rate = (i // 12 % 10) / 22  # up to four words in ten are replaced, left out or doubled
        out = [y for x in w for y in (((f"e{rnd.randrange(9**6)}",), (), (x, x))[rnd.randrange(3)] if rnd.random() < rate else (x,))]
        texts.append(f"{prose(rnd, 15)} {' '.join(out)} {prose(rnd, 15)}")
    number = lambda t: np.array([hash(x) for x in t.split()])
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if decontaminate.smith_waterman(number(x), number(t))[0] >= decontaminate.SCORE * 2 * len(x.split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 150


def test_url_filter(spark):
    urls = ["http://a.com/en/1?x", "https://A.Example.COM/en/7#t", "http://x.net", "http://xnet/de/", "http://b.example.net/de/81", None, "nourl", "http://bad.org/x", "http://good.org/es/", "ftp://h?/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/y", "", 1) for i in range(30)] + [(200 + i, "http://good.org/y", "", 1) for i in range(30)], "page_id long, url string, html string, bound int")
    labels = spark.createDataFrame([(100 + i, 0, None) for i in range(30)] + [(200 + i, 1, 0) for i in range(30)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == 71
    assert got[0] == ("a.com", "/en/1", "com/en/", "block") and got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("x.net", "", None, "allow") and got[3][:3] == ("xnet", "/de/", None) and got[4] == ("b.example.net", "/de/81", "example.net/de/8", "block")
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7] == ("bad.org", "/x", None, "block") and got[8] == ("good.org", "/es/", "org/es/", "block")
    assert got[9][:3] == ("h", "", None) and got[10] == ("com", "/en/", "com/en/", "block") and got[205][3] == "allow"
    assert {r["verdict"] for r in url_filter.judge(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    bad = next(r for r in url_filter.judge(pages, labels).collect() if r["page_id"] == 100)
    assert bad["bad_rate"] > bad["bad_bound"] > 0.5  # the overall rate is a half
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("a.b.example.com",), ("com",), ("",)], "host string")
    got = {r["host"]: tuple(r)[1:] for r in hosts.select("host", *url_filter.levels(F.col("host"))).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.example.com": ("com", "example.com"), "com": ("com", "com"), "": ("", "")}
    long = spark.createDataFrame([(1, "http://" + "a" * 100_000 + ".com/" + "b" * 100_000, "", 1), (1, "http://x.com/en/", None, None)], pages.schema)
    assert sorted(r["verdict"] for r in url_filter.judge(long, labels).collect()) == ["allow", "block"]


def test_reputation_sql(spark):
    """Hosts that differ: the reputation blocks some, the same ones in Spark and in SQL."""
    rnd = rng(21)
    hosts = [(f"h{i}.d{i % 4}.{('com', 'co.uk', 'org')[i % 3]}", (0.05, 0.9)[i % 5 == 0]) for i in range(30)]
    pages = [(n, f"http://{h}/p", "", 1) for n, (h, _) in enumerate(hosts * 12)]
    labels = [(n, int(rnd.random() > hosts[n % 30][1]), 0) for n in range(len(pages)) if n % 3]
    names = "page_id long, url string, html string, n long", "doc_id long, quality int, toxic int"
    p, la = (spark.createDataFrame(x, t) for x, t in zip((pages, labels), names, strict=True))
    got = sorted(map(tuple, url_filter.judge(p, la).collect()), key=str)
    con = duckdb.connect()
    for t, df in (("pages", p), ("labels", la)):
        con.register(t, df.toArrow())
    assert got == sorted(con.execute(url_filter.sql()).fetchall(), key=str)
    blocked = {r[1] for r in got if r[4] == "block" and r[3] is None}
    assert blocked and blocked <= {h for h, x in hosts if x > 0.5}



def bigram(train, held, vocab, discount=0.75):
    """Mean log probability of held-out ids by a bigram model with absolute discounting that backs off to shares."""
    counts = np.bincount(np.concatenate(train), minlength=vocab) + 0.5
    pairs, after = collections.Counter(), collections.defaultdict(list)
    for x in train:
        pairs.update(zip([vocab, *x[:-1].tolist()], x.tolist(), strict=True))
    for (a, _), n in pairs.items():
        after[a].append(n)
    seen = {a: (sum(n), len(n)) for a, n in after.items()}
    share, total = counts / counts.sum(), 0.0
    for x in held:
        for a, y in zip([vocab, *x[:-1].tolist()], x.tolist(), strict=True):
            n, kinds = seen.get(a, (0, 0))
            total += math.log((max(pairs[a, y] - discount, 0) + discount * kinds * share[y]) / n if n else share[y])
    return total / sum(map(len, held))


def test_lm_base(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    toks = {r[0]: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")), None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    c = collections.Counter(w for d, t in toks.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    old, lm_score.HEAD, lm_score.WORDS, lm_score.GROUP = (lm_score.HEAD, lm_score.WORDS, lm_score.GROUP), 300, 2000, 30_000
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_lm_score"](spark, SF).collect()}
    lm_score.HEAD, lm_score.WORDS, lm_score.GROUP = old
    assert len(got) == len(toks)
    for d, t in toks.items():
        g = got[d]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[d], len(t), sum(w in c for w in t), n)
        assert abs(g["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t)
        assert g["score"] < 0
    odd = lm_score.scores(odd_docs(spark), RANKS, 50256).collect()
    assert len(odd) == 11 and all(math.isfinite(r["score"]) for r in odd)
    assert lm_score.scores(empty_docs(spark), RANKS, 50256).count() == 0


def test_lm_encode(spark, docs):
    """The subword ids of every text are the library's, word by word."""
    sub = lm_score.Subwords(RANKS)
    alone = lambda t: [y for w in (t or "").encode().lower().split() for y in sub.encode(" " + w.decode())] + [50256]
    odd = ["a\u00a0 \u00a0b c", "\u3000 x\u3000", "é\x85 \x1c q", "it's 'll  DON'T 12,5", "\U0001f600 日本語"]
    rows = docs.select("doc_id", "text").union(odd_docs(spark).where("doc_id is not null").selectExpr("doc_id + 10000000", "text"))
    rows = rows.union(spark.createDataFrame([(20_000_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).withColumn("text_hash", F.lit(0).cast("bigint"))
    codes = rows.mapInArrow(lm_score._encode(RANKS, 50256), lm_score.CODES_SQL).where("kind = 0").collect()
    want = collections.Counter((r["doc_id"], tuple(alone(r["text"]))) for r in rows.collect())
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in codes) == want


def test_lower_words():
    texts = ["", " \t\n", "A b\x0b\x0cB a\r", " É é x\x1c\x85\u00a0\u3000y ", "b" * 40, "x"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array([None, *texts, None], kind)], names=["text"])
        n, at, words = common.lower_words(common.strings(batch).slice(1))
        want = [t.encode().lower().split() for t in [*texts, ""]]
        assert n.tolist() == list(map(len, want)) and [words[i] for i in at] == sum(want, [])
        assert len(set(words)) == len(words)
        n, at, words = common.lower_words(common.strings(batch).slice(0, 0))
        assert len(n) == len(at) == len(words) == 0
    assert lm_score.spans(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4] and not len(lm_score.spans(np.zeros(0, int), np.zeros(0, int)))


def test_lm_words_once(monkeypatch):
    """Each distinct word of a run of texts is looked up and hashed once, not once for each place."""
    texts = ["the cat and the dog and THE end"] * 50 + ["another cat"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(51), pa.int64()), pa.array(texts), pa.array(range(51), pa.int64())], names=["doc_id", "text", "text_hash"])
    looked, hashed = [], []
    of, hashes = lm_score.Numbers.of, lm_score._hashes
    monkeypatch.setattr(lm_score.Numbers, "of", lambda self, words: looked.extend(words) or of(self, words))
    monkeypatch.setattr(lm_score, "_hashes", lambda words: hashed.extend(words) or hashes(words))
    monkeypatch.setattr(lm_score, "_STATES", {})
    rows = [r for b in lm_score._encode(RANKS, 50256)(iter([batch])) for r in b.to_pylist()]
    assert sorted(looked) == [b"and", b"another", b"cat", b"dog", b"end", b"the"]
    train = [t.lower().split() for d, t in enumerate(texts) if not lm_score.held_out(d)]
    assert {r["key"]: r["n"] for r in rows if r["kind"] == 1} == {lm_score._long(int(hashes([w.encode()])[0])): n for w, n in collections.Counter(sum(train, [])).items()} | {lm_score._long(lm_score.END): len(train)}
    subwords = collections.Counter(x for r in rows if r["kind"] == 0 and not r["held_out"] for x in np.frombuffer(r["ids"], "<u2").tolist())
    assert {r["key"]: r["n"] for r in rows if r["kind"] == 2} == subwords
    hashed.clear()
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    head = np.sort(hashes([b"the", b"and"]))
    base = [r for b in lm_score._base(head, np.ones(2), 0.5)(iter([batch])) for r in b.to_pylist()]
    assert len(hashed) == 6 and [r["n_tokens"] for r in base] == [9] * 50 + [3] and [r["head_n"] for r in base] == [6] * 50 + [1]
    assert [sum(r["tail_n"]) for r in base] == [3] * 50 + [2] and base[0]["head_sum"] == 5.5


def test_lm_order(spark, monkeypatch):
    """The same scores however the rows lie, with several shards, so copies are averaged."""
    monkeypatch.setattr(lm_score, "SHARD", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    got = {r["doc_id"]: r["score"] for r in lm_score.scores(docs, RANKS, 50256).collect()}
    again = {r["doc_id"]: r["score"] for r in lm_score.scores(docs.repartition(5), RANKS, 50256).collect()}
    assert all(abs(got[d] - again[d]) <= 1e-4 + 1e-6 * abs(got[d]) for d in got) and len(got) == len(again) == docs.count()


def test_lm_beats_bigram(spark):
    """Held-out subwords: better than a bigram model with back-off."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in lm_score.scores(docs, RANKS, 50256).collect()}
    sub = lm_score.Subwords(RANKS)
    ids = {r["doc_id"]: np.array([*(sub.of(w)[0].tolist() if (w := (r["text"] or "").encode().lower().split()) else ()), 50256]) for r in docs.collect()}
    train, held = [x for d, x in ids.items() if not lm_score.held_out(d)], [d for d in ids if lm_score.held_out(d)]
    own = sum(got[d] for d in held) * math.log(10) / sum(len(ids[d]) for d in held)
    other = bigram(train, [ids[d] for d in held], 50257)
    assert own > other + 0.02, (own, other)


def fitted(counts, seqs=(), steps=0):
    """A model with its choices in the classes counted from sequences, and its trainer."""
    vocab = attention.Vocabulary(counts)
    t = attention.Trainer(attention.Model(attention.initial(vocab.class_share), vocab))
    for _ in range(steps):
        t.learn(*t.model.windows(seqs)[:2])
    pairs = np.bincount(vocab.pairs(*t.model.windows(seqs)[:2]), minlength=vocab.PAIRS) if len(seqs) else np.zeros(vocab.PAIRS, int)
    t.model.within = vocab.within(np.flatnonzero(pairs), pairs[pairs > 0])
    return t


def test_attention(monkeypatch):
    monkeypatch.setattr(attention, "ROWS", 40)
    monkeypatch.setattr(attention, "COLUMNS", 100)
    monkeypatch.setattr(attention.Vocabulary, "PAIRS", 42 * 101)
    rnd = np.random.default_rng(4)
    vocab = 300
    counts = rnd.integers(0, 2000, vocab) // np.arange(1, vocab + 1)
    seqs = [rnd.integers(0, vocab, n) for n in (1, 8, 9, 16, 17, 70)]
    m = fitted(counts, seqs).model
    v = m.vocab
    x, y, owner = m.windows(seqs)
    assert (y != m.pad).sum() == 121 and np.bincount(owner).tolist() == [1, 1, 1, 1, 2, 5]
    m.own[:] = rnd.standard_normal(m.own.shape) * 0.3
    lp, p, k = m.log_probs(x, y), m.p, 40
    ctx = [m.bos, *seqs[5][:k].tolist()]  # one position by hand, with no batch and no table
    e = [p["e"][v.cls[i]] + m.own[i] for i in ctx]
    first = k // attention.STRIDE * attention.STRIDE - attention.BACK
    q = e[k] @ p["q"]
    a = {j: math.exp(q @ (e[j] @ p["k"]) / math.sqrt(attention.KEY) + p["b"][k - j]) for j in range(max(first, 0), k + 1)}
    h = np.append(np.tanh(sum(w * (e[j] @ p["v"]) for j, w in a.items()) / sum(a.values()) + e[k] @ p["r"]), 1)
    met = collections.Counter((v.row[b], y) for s in seqs for b, y in zip([m.bos, *s[:-1].tolist()], s.tolist(), strict=True) if v.column[y] < attention.COLUMNS)
    behind = collections.Counter()
    for (r, y), n in met.items():
        behind[r, v.cls[y]] += n

    def by_hand(y, b=ctx[k]):
        z = h @ p["o"]
        r, c = v.row[b], v.cls[y]
        return z[c] - math.log(np.exp(z).sum()) + math.log((met[r, y] + attention.PRIOR * v.share[y]) / (behind[r, c] + attention.PRIOR))

    w = np.flatnonzero(owner == 5)[k // attention.STRIDE]
    assert abs(lp[w, k % attention.STRIDE] - by_hand(seqs[5][k])) < 1e-4
    for b in (ctx[k], m.bos, int(np.argmax(counts)), int(np.argmin(counts))):
        assert abs(sum(math.exp(by_hand(y, b)) for y in range(vocab)) - 1) < 1e-4  # a distribution over all subwords
    flip = [s.copy() for s in seqs]
    flip[5][41:] = (flip[5][41:] + 1) % vocab
    assert np.allclose(m.log_probs(*m.windows(flip)[:2])[owner == 5].ravel()[:41], lp[owner == 5].ravel()[:41], atol=1e-5)
    x, y, _ = m.windows([rnd.integers(0, vocab, n) for n in (1, 9, 30)])
    loss = lambda: -m.log_probs(x, y).sum() / 40
    flat, rows, own = m.gradients(x, y)
    for table, g in [(m.flat, zip(range(attention.SIZE), flat, strict=True)), (m.own, zip(rows, own, strict=True))]:
        for r, gr in list(g)[::11]:
            at = (r, 3) if table.ndim == 2 else r
            want, old = float(gr[3] if table.ndim == 2 else gr), table[at]
            table[at] = old + 1e-2
            up = loss()
            table[at] = old - 1e-2
            assert abs((up - loss()) / 2e-2 - want) < 2e-3 + 0.05 * abs(want), (at, want)
            table[at] = old


def test_attention_learns():
    rnd = np.random.default_rng(5)
    counts = rnd.integers(0, 2000, 300) // np.arange(1, 301)
    cls = attention.classes_of(counts)
    a, b, c, d = np.flatnonzero(cls == cls[299])[:4].tolist()  # rare subwords of one class
    pairs = [np.array([x, y] * 30) for x, y in ((a, c), (b, d))] * 30
    m = fitted(counts, pairs, 100).model
    lp = lambda s, m=m: float(m.log_probs(*m.windows([np.array(s)])[:2]).sum())
    assert lp([a, c] * 10) > lp([a, d] * 10) + 10 and lp([b, d] * 10) > lp([b, c] * 10) + 10  # classes alone cannot tell
    # what stands eight places back decides the class: pairs cannot tell, attention over subwords can
    u, w = (np.flatnonzero(cls == k)[0] for k in np.unique(cls)[[1, 5]])
    far = [np.array([x, *([u] * 7), z]) for x, z in ((a, u), (b, w))] * 200
    far = fitted(counts, far, 150).model
    assert lp([a, *([u] * 7), u], far) > lp([a, *([u] * 7), w], far) + 2 and lp([b, *([u] * 7), w], far) > lp([b, *([u] * 7), u], far) + 2


def test_components(spark):
    rnd = rng(11)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0
