"""Quality rules: base measures of each text and cross-document line frequency.

Lines are normalised (A-Z lowered, digits to 0, white space to single spaces) and hashed. A line
that stands in more than LINE_DOCS distinct documents of one host (``source``) is boilerplate
there, at every size of corpus: it is removed from all documents but the first (smallest doc_id)
that holds it. Exact copies of a text count as one document: copying a text makes none of its lines
boilerplate (whole copies are for near_dedup to find). A document left with too small a share of
its words is depleted and rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sumweave.llm import common as C

#: A line may stand in this many documents of a host.
LINE_DOCS = 5
#: Share of its words a document must keep.
KEEP_SHARE = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_ZEROS = bytes.maketrans(b"123456789", b"000000000")

MEASURES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("digest", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))]
)
MEASURES_SQL = "row long, doc_id long, host string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def normal_line(words: list[bytes]) -> bytes:
    return b" ".join(words).lower().translate(_ZEROS)


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def measure(text: bytes) -> tuple:
    words = text.split()
    n = len(words)
    repeat = 0
    if n > 3:
        _, at, count = np.unique(C.windows(C.word_hashes(words), 3), return_inverse=True, return_counts=True)
        again = np.zeros(n, bool)
        often = count[at] > 1
        for k in range(3):
            again[k : n - 2 + k] |= often
        repeat = int(again.sum())
    seen, dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        if w := line.split():
            dup += line in seen
            seen.add(line)
            h = _long(xxhash.xxh64_intdigest(normal_line(w)))
            lines[h] = lines.get(h, 0) + len(w)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, list(lines), list(lines.values())


def _measures(it):
    row = TaskContext.get().partitionId() << 36
    for b in it:
        texts = C.raw_texts(b)
        cols = list(zip(*map(measure, texts), strict=True)) or [[]] * 7
        data = {"row": list(range(row, row + len(texts))), **{c: b.column(c).to_pylist() for c in ("doc_id", "host", "digest")}}
        row += len(texts)
        yield C.batches(data | dict(zip(MEASURES.names[4:], cols, strict=True)), MEASURES)


def _digest():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    return C.id_text(docs, F.col("source").cast("string").alias("host"), _digest().alias("digest"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def frequent_lines(measures: DataFrame, line_docs: int) -> DataFrame:
    """(host, line, n_docs, first) of lines above the limit."""
    lines = measures.select("host", "digest", "doc_id", F.explode("lines").alias("line"))
    one = lines.groupBy("host", "line", "digest").agg(F.min("doc_id").alias("first"))
    return one.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") > line_docs)


def verdicts(docs: DataFrame, line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """A row a document: row, doc_id, digest, the base measures, base_failed, removed_words, kept.

    A null text has no words and fails the base rule. A null source is a host of its own. Texts are
    measured whole, of any length. Of rows that hold a frequent line, those of the smallest doc_id keep it. Rows
    that repeat a doc_id are measured each; the first holder of a line is told by doc_id (where all
    are null there is none). Other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, line_docs, keep_share).drop("gone")


def _judged(docs: DataFrame, line_docs: int, keep_share: float) -> DataFrame:
    """The verdicts with ``gone``, the hashes of the lines to remove (null for none)."""
    C.prepare(docs.sparkSession)
    m = C.written(_rows(docs).mapInArrow(_measures, MEASURES_SQL), "measures")
    often = C.written(frequent_lines(m, line_docs), "lines").select(F.col("host").alias("_host"), F.col("line").alias("_line"), "first")
    lines = m.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "doc_id", "host", "l.*")
    gone = lines.join(often, (F.col("lines") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("row").agg(F.sum("line_words").cast("long").alias("removed_words"), F.collect_list("lines").alias("gone"))
    out = m.drop("lines", "line_words").join(gone, "row", "left").fillna(0, ["removed_words"])
    left = (F.col("n_words") - F.col("removed_words")) >= F.lit(keep_share) * F.col("n_words")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & left)


def cleaned(docs: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """A row a document: doc_id, source, text without its host's frequent lines.

    Lines without words stay. A document that loses all its lines has an empty text, a null text
    stays null. Rows that repeat a doc_id come out each, as they would alone. Other columns are
    ignored; an empty table gives no rows.
    """
    C.prepare(docs.sparkSession)
    rows = _rows(docs)
    m = C.written(rows.mapInArrow(_measures, MEASURES_SQL), "measures")
    often = C.written(frequent_lines(m, line_docs), "lines").select(F.col("host").alias("_host"), "line", "first")
    lines = m.select("doc_id", "host", "digest", F.explode("lines").alias("line")).distinct()
    gone = lines.join(often.withColumnRenamed("line", "_line"), (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("digest").alias("_digest")).agg(F.collect_list("line").alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("digest") == F.col("_digest"))
    return rows.join(gone, same, "left").select("doc_id", F.col("host").alias("source"), "text", "gone").mapInArrow(_strip, "doc_id long, source string, text string")


def _without(text: str, gone: list[int]) -> str:
    off = set(gone)
    split = [(x, x.encode().split()) for x in text.split("\n")]
    return "\n".join(x for x, w in split if not w or _long(xxhash.xxh64_intdigest(normal_line(w))) not in off)


def _strip(it):
    for b in it:
        texts = [_without(t, gone) if gone else t for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(texts, pa.string())], names=["doc_id", "source", "text"])


@F.arrow_udf(StringType())
def _stripped(text: pa.Array, gone: pa.Array) -> pa.Array:
    return pa.array([_without(t, g) if g else None for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def filtered(docs: DataFrame, line_docs: int = LINE_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, without their host's frequent lines (the first holder of
    a line keeps it); ``n_chars``, where there is one, follows a changed text. Rows that repeat a
    doc_id are decided each."""
    kept = _judged(docs, line_docs, keep_share).where("kept").groupBy("doc_id", "host", "digest").agg(F.first("gone").alias("gone"))
    kept = kept.select(*[F.col(c).alias(f"_kept_{c}") for c in kept.columns])
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_kept_doc_id")) & docs["source"].cast("string").eqNullSafe(F.col("_kept_host")) & (_digest() == F.col("_kept_digest"))
    out, changed = docs.join(kept, same), F.col("_kept_gone").isNotNull()
    old = F.when(changed, F.col("text").cast("string"))
    out = out.withColumn("text", F.coalesce(_stripped(old, F.col("_kept_gone")), F.col("text").cast("string")).cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = f"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls
  FROM documents),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base WHERE len(w) > 2)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, l, regexp_replace(array_to_string(list_filter(string_split_regex(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' '), '[0-9]', '0', 'g') AS line,
    len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS k FROM (SELECT doc_id, host, t, unnest(ls) AS l FROM base)),
freq AS (SELECT host, line, count(DISTINCT t) AS n, min(doc_id) AS first FROM lines GROUP BY host, line),
hit AS (SELECT host, line, first FROM freq WHERE n > {LINE_DOCS}),
gone AS (SELECT l.doc_id, sum(l.k) AS removed FROM lines l JOIN hit h ON l.host = h.host AND l.line = h.line WHERE l.doc_id <> h.first GROUP BY l.doc_id),
m AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM base b LEFT JOIN rep ON b.doc_id = rep.doc_id LEFT JOIN gone ON b.doc_id = gone.doc_id)
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - removed_words >= {KEEP_SHARE} * n_words AS kept
FROM m
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op4_quality_rules."""
    return verdicts(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
