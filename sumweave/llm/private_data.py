"""Personal data: base expressions, and bootstrapped contextual extraction on top.

The base spans, and credentials of well-known forms, are seeds. Every other string that could be an
identifier at all (a run of digits, a run of letters and digits, something with an @, ...) is an
instance without a label. The words around a seed or instance are its lexical patterns: three words
to the left, two, two with a gap between, one to each side. Spark scores the graph of patterns and
instances in turns: a pattern is as good as the seeds and good instances it stands around against
those of other kinds (instances without a label count little against it), an instance becomes good
by the good patterns it stands in. Instances that end above the limit are added spans, so an
identifier in no known form is found by its company.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans: the base's, then secrets.
ALL = (*KINDS, "secret")
#: The base expressions.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The ip expression with starts inside a run of digits left out: where the run's first digit fails, so
#: do the others, and a match takes its last run whole. Long runs are then read once.
_IP = re.compile(r"(?<![0-9])" + BASE["ip"].pattern)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Public forms of credentials, the seeds of the kind "secret".
SECRET = re.compile(r"(?<![0-9A-Za-z_])(?:[0-9a-f]{64}|[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,})(?![0-9A-Za-z_])")
#: What a pattern may extract, by kind: far wider than the seeds.
WIDE = {
    "email": re.compile(r"[^\s@\"<>(),;]+@[^\s@\"<>(),;]+|[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)*"),
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?=[0-9A-Fa-f:.]*[0-9])[0-9A-Fa-f]{0,4}(?:[.:][0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){7,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,14}(?![0-9])"),
}
#: Shortest run of letters and digits a pattern may take for a secret, and what ends a run.
RUN, ENDS = 8, " \t\n\r\f\v\"'<>()[]{},;="
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
ROUNDS = 3
#: Seeds (or as much score) a pattern must have, the confidence patterns and instances must reach, and
#: the weight of an instance without a label against a pattern.
SEEDS, CONFIDENCE, UNLABELLED = 3, 0.75, 0.25

SPANS = "array<struct<kind:int,start:int,stop:int,seed:int>>"
OCC = "struct<kind:int,seed:int,start:int,stop:int,instance:bigint,patterns:array<bigint>>"
ROW = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("occ", pa.list_(pa.struct([("kind", pa.int32()), ("seed", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])))])
ROW_SQL = f"doc_id long, row string, occ array<{OCC}>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """The email expression's matches, found from each @ outwards: a text is read once, however long
    its runs of letters are."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        part = text[low:at]
        start = low + len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for k, (kind, found) in enumerate((("ip", _IP), ("card", BASE["card"]), ("phone", BASE["phone"])), 1):
        if kind == "phone" and "+" not in text:
            continue
        out += [(k, m.start(), m.end()) for m in found.finditer(text) if passes(kind, m[0])]
    return out


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans, then well-known credentials that touch none: (kind number, start, end)."""
    base = base_spans(text)
    free = _untouched(base)
    return base + [(4, *m.span()) for m in SECRET.finditer(text) if free(*m.span())]


def _untouched(taken: list[tuple[int, int, int]]):
    """Whether a stretch touches no taken span."""
    spans = sorted((a, b) for _, a, b in taken)
    starts, ends = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))

    def free(start: int, stop: int) -> bool:
        before = bisect.bisect_left(starts, stop)
        return not before or ends[before - 1] <= start

    return free


def _runs(text: str):
    """Runs of at least RUN characters between ENDS that hold a digit and a letter, less marks at their ends."""
    after = 0
    for m in _DIGITS.finditer(text):
        if m.start() < after:
            continue
        a, z = m.span()
        while a > after and text[a - 1] not in ENDS:
            a -= 1
        while z < len(text) and text[z] not in ENDS:
            z += 1
        after = z
        while z > a and not text[z - 1].isalnum():
            z -= 1
        if z - a >= RUN and any(c.isalpha() for c in text[a:z]):
            yield a, z


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings a pattern may extract that touch no seed: (kind number, start, end)."""
    if not _DIGITS.search(text) and "@" not in text and "at" not in text:
        return []
    free, out = _untouched(taken), []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text and "(at)" not in text and "[at]" not in text:
            continue
        out += [(k, *m.span()) for m in WIDE[kind].finditer(text) if free(*m.span())]
    return out + [(4, a, z) for a, z in _runs(text) if free(a, z)]


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def patterns(text: str, start: int, stop: int) -> list[int]:
    """Hashes of the patterns around a stretch. Words and single marks are tokens, in lower case, with
    digits as 0; a pattern must hold a word."""
    clean = lambda s: [_DIGITS.sub("0", t.lower()) for t in _TOKEN.findall(s)]
    left, right = clean(text[max(0, start - 80) : start])[-3:], clean(text[stop : stop + 40])[:1]
    found = []
    if len(left) == 3:
        found += [("3", *left), ("g", left[0], left[2])]
    if len(left) >= 2:
        found.append(("2", *left[-2:]))
    if left and right:
        found.append(("b", left[-1], right[0]))
    return [_hash(" ".join(p)) for p in found if any(t[0].isalpha() for t in p[1:])]


def _extract(it):
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for b in it:
        rows, occ = [], []
        for t in b.column("text").to_pylist():
            t = t or ""
            seeds = seed_spans(t)
            both = [(1, s) for s in seeds] + [(0, s) for s in candidates(t, seeds)]
            rows.append(f"{part}:{n}")
            n += 1
            occ.append([{"kind": k, "seed": seed, "start": a, "stop": z, "instance": _hash(t[a:z]), "patterns": patterns(t, a, z)} for seed, (k, a, z) in both])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows), pa.array(occ, ROW.field("occ").type)], schema=ROW)


def score(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Good instances (kind, instance, score) of edges (kind, pattern, instance, seed).

    A pattern's confidence for a kind is s / (s + other + UNLABELLED * rest + 1): s is the sum of its
    instances' scores, other its seeds of other kinds, rest what its instances without a label
    lack of a score of 1. It counts from s = SEEDS on. An instance's score is 1 - product of
    (1 - confidence) over its patterns that reach CONFIDENCE; seeds stay at 1.
    """
    edges = C.written(edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    inst = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("given"))
    total = edges.where("seed = 1").groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    for _ in range(rounds):
        inst = C.written(inst, "instances")
        pat = edges.join(inst, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum("score").alias("s"), F.sum(F.col("given")).alias("seeds"), F.sum(1 - F.col("score")).alias("rest"))
        pat = pat.where(F.col("s") >= SEEDS).join(total, "pattern", "left")
        conf = F.col("s") / (F.col("s") + F.coalesce("total", F.lit(0)) - F.col("seeds") + UNLABELLED * F.col("rest") + 1)
        pat = pat.select("kind", "pattern", conf.alias("conf")).where(F.col("conf") >= CONFIDENCE)
        lift = edges.join(pat, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("up"))
        inst = inst.join(lift, ["kind", "instance"], "left").select("kind", "instance", F.when(F.col("given") == 1, 1.0).otherwise(F.coalesce("up", F.lit(0.0))).alias("score"), "given")
    return inst.where((F.col("score") >= CONFIDENCE) & (F.col("given") == 0)).select("kind", "instance", "score")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_secret (credentials of known forms),
    n_found (added by patterns), spans: array of (kind, start, stop, seed).

    Offsets are code points. A stretch that is good for several kinds is of the one with the best
    score (the first of equals). A null text is empty. Rows that repeat a doc_id come out each
    (their strings count as one instance). Texts are read in one pass, however long. Other columns
    are ignored; an empty table gives no rows.
    """
    C.prepare(docs.sparkSession)
    rows = C.written(C.id_text(docs).mapInArrow(_extract, ROW_SQL), "occurrences")
    occ = rows.where(F.size("occ") > 0).select("row", F.explode("occ").alias("o")).select("row", "o.*")
    good = score(occ.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")))
    more = occ.where("seed = 0").join(good, ["kind", "instance"])
    more = more.groupBy("row", "start", "stop").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    more = more.groupBy("row").agg(F.collect_list(F.struct((-F.col("best.kind")).alias("kind"), "start", "stop", F.lit(0).alias("seed"))).alias("more"))
    seeds = F.transform(F.filter("occ", lambda o: o["seed"] == 1), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["stop"].alias("stop"), o["seed"].alias("seed")))
    out = rows.join(more, "row", "left").withColumn("spans", F.array_sort(F.concat(seeds, F.coalesce("more", F.expr(f"cast(array() as {SPANS})")))))
    count = lambda test: F.expr(f"cast(size(filter(spans, o -> {test})) AS bigint)")
    counts = [count(f"o.seed = 1 AND o.kind = {k}").alias(f"n_{kind}") for k, kind in enumerate(ALL)]
    return out.select("doc_id", *counts, count("o.seed = 0").alias("n_found"), "spans")


def span_text(spans):
    names = F.array(*[F.lit(k) for k in ALL])
    return F.array_join(F.transform(spans, lambda o: F.concat_ws(":", F.element_at(names, o["kind"] + 1), o["start"].cast("string"), o["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op3_private_data."""
    out = find(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda o: (o["seed"] == 1) & (o["kind"] < len(KINDS)))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "n_secret", "n_found", F.size("spans").cast("long").alias("n_spans"))
