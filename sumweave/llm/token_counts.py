"""Edit-aware token counts.

A document keeps its pre-tokens in a segment tree: leaves are short runs of pre-tokens with their
text, lengths and token counts, inner nodes hold sums of the latter two. An edit is located by
descending on lengths; only the pre-tokens it touches and a few characters of context before them
are cut anew, up to where the cut meets an old border behind the edit; then the leaf's sums and
those of its ancestors are updated. The total is the root's. No step touches the whole text.

A special token's string in a text is ordinary text and counts as such (the library's
``encode_special_tokens``), so a document cannot pass for a control token.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C

#: Pre-tokens to a leaf when a tree is built.
LEAF = 64
#: A border may depend on this many characters behind it (the longest contraction looked for, or
#: white space and the character after it).
LOOK = 3
#: The public byte-level BPE's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_tokens", "n_tokens_edited", "n_chars", "n_chars_edited", "n_edits", "recut_chars")])
COUNTS_SQL = "doc_id long, n_tokens long, n_tokens_edited long, n_chars long, n_chars_edited long, n_edits long, recut_chars long"


class Counter:
    """Token counts of pre-tokens, cached."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(path).model.tokenize
        self.letters = dict(enumerate(C.byte_letters()))
        self.cut = regex.compile(PATTERN)
        counter = self

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= C.CACHE:
                    self.clear()
                n = self[piece] = counter.count(piece)
                return n

        self.counts = Counts()

    def count(self, piece: str) -> int:
        return len(self.one(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)))

    def of(self, pieces: list[str]) -> list[int]:
        return list(map(self.counts.__getitem__, pieces))


class Tree:
    """A document's pre-tokens under a segment tree of (characters, tokens) sums."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.recut = counter, 0
        pieces = counter.cut.findall(text)
        self._plant(pieces, counter.of(pieces))

    def _plant(self, pieces: list[str], counts: list[int]) -> None:
        parts = [(pieces[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(pieces), LEAF)] or [([], [])]
        self.leaves = [("".join(p), list(map(len, p)), c) for p, c in parts]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size, self.chars, self.tokens = size, [0] * (2 * size), [0] * (2 * size)
        for k, (text, _, c) in enumerate(self.leaves):
            self.chars[size + k], self.tokens[size + k] = len(text), sum(c)
        for k in range(size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.leaves)

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the pre-token that holds character ``at``."""
        k, base = 1, 0
        while k < self.size:
            k *= 2
            if at - base >= self.chars[k] and self.chars[k + 1]:
                base += self.chars[k]
                k += 1
        return k - self.size, base

    def _update(self, leaf: int) -> None:
        k = self.size + leaf
        text, _, counts = self.leaves[leaf]
        self.chars[k], self.tokens[k] = len(text), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end); positions are clipped to the text."""
        leaves = self.leaves
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        shift = len(new) - (end - start)
        first, base = self._leaf(max(0, start - LOOK))
        text, lengths, counts = leaves[first]
        head, at = 0, base
        while head < len(lengths) and at + lengths[head] <= start - LOOK:
            at += lengths[head]
            head += 1
        # the text from ``at`` on, leaf by leaf as far as it is needed
        local, have = text[at - base :], first
        while at + len(local) < end:
            have += 1
            local += leaves[have][0]
        local = local[: start - at] + new + local[end - at :]
        # old borders from here on: ``old`` is one, in front of pre-token i of ``leaf``
        leaf, i, old = first, head, at
        cut, cuts, pos = self.counter.cut, [], 0
        while True:
            while (old < end or old + shift < at + pos) and leaf < len(leaves):
                if i >= len(leaves[leaf][1]):
                    leaf, i = leaf + 1, 0
                else:
                    old += leaves[leaf][1][i]
                    i += 1
            if old >= end and old + shift == at + pos and at + pos >= start + len(new):
                break
            m = cut.match(local, pos)
            while (m is None or m.end() > len(local) - LOOK) and have + 1 < len(leaves):
                have += 1
                local += leaves[have][0]
                m = cut.match(local, pos)
            if m is None:
                break
            cuts.append(m[0])
            pos = m.end()
        self.recut += pos
        if leaf >= len(leaves):
            leaf, i = len(leaves) - 1, len(leaves[-1][1])
        rest_text, rest_lengths, rest_counts = leaves[leaf]
        rest = rest_text[sum(rest_lengths[:i]) :], rest_lengths[i:], rest_counts[i:]
        own = text[: at - base] + "".join(cuts), lengths[:head] + list(map(len, cuts)), counts[:head] + self.counter.of(cuts)
        if leaf == first:
            leaves[first] = own[0] + rest[0], own[1] + rest[1], own[2] + rest[2]
        else:
            leaves[first], leaves[leaf] = own, rest
            for x in range(first + 1, leaf):
                leaves[x] = "", [], []
                self._update(x)
            self._update(leaf)
        self._update(first)
        if len(leaves[first][1]) > 8 * LEAF:
            pieces = []
            for t, sizes, _ in leaves:
                a = 0
                for n in sizes:
                    pieces.append(t[a : a + n])
                    a += n
            self._plant(pieces, [c for _, _, x in leaves for c in x])


_COUNTERS: dict[str, Counter] = {}


def _count(path: str):
    def run(it):
        counter = _COUNTERS.setdefault(path, None) or Counter(path)
        _COUNTERS[path] = counter
        for b in it:
            out = {c: [] for c in COUNTS.names}
            for d, t, edits in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                tree = Tree(t or "", counter)
                before, chars = tree.total, tree.n_chars
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["start"] or 0 if e["end"] is None else e["end"], e["new"] or "")
                for c, v in zip(COUNTS.names, (d, before, tree.total, chars, tree.n_chars, len(edits or ()), tree.recut), strict=True):
                    out[c].append(v)
            yield C.batches(out, COUNTS)

    return run


def count_tokens(docs: DataFrame, edits, tokenizer: str) -> DataFrame:
    """Counts before and after each document's edits.

    ``edits``: a column of arrays of (start, end, new) in code points of the text as the earlier
    edits left it, applied in order. Columns: doc_id, n_tokens, n_tokens_edited, n_chars,
    n_chars_edited, n_edits, recut_chars (characters cut anew by the edits). A null text is empty;
    null edits are none; positions outside are clipped; edits at one place apply in the order given.
    Texts of any length are counted whole. Rows that repeat a doc_id are counted
    each. Other columns are ignored; an empty table gives no rows.
    """
    C.prepare(docs.sparkSession)
    return C.id_text(docs, edits.alias("edits")).mapInArrow(_count(tokenizer), COUNTS_SQL)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with a column ``edits`` from a table (doc_id, at, start, end, new), ``at`` being the
    order; documents without an entry get null."""
    own = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.expr("transform(sort_array(collect_list(struct(at, start, end, new))), e -> struct(e.start as start, e.end as end, e.new as new))").alias("edits"))
    return docs.join(own, docs["doc_id"] == F.col("_id"), "left").drop("_id")


#: The query's edit script: for k = 0..3 a place by hash; cut 0, 9, 18 or 27 characters, put a mark in.
SCRIPT = "transform(sequence(0, 3), k -> struct(cast(pmod(xxhash64(doc_id, k), greatest(length(text), 1)) as int) as start, cast(pmod(xxhash64(doc_id, k), greatest(length(text), 1)) + 9 * k as int) as end, element_at(array('', ' [cut]', 'n''t ', '  x'), k + 1) as new))"


def query(spark, sf_dir: str) -> DataFrame:
    """op1_token_counts."""
    import public_tokenizers

    return count_tokens(C.table(spark, sf_dir, "documents"), F.expr(SCRIPT), public_tokenizers.path("byte_bpe_50k.json"))
