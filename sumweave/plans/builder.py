"""Compile a query to one DataFrame."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from sumweave.operators import relational as R
from sumweave.plans.model import Col, JoinPred, Query
from sumweave.plans.parser import QueryError, parse_query
from sumweave.plans.rewrite import components, dedupe_selections

log = logging.getLogger(__name__)


def _joined(scans: dict[int, DataFrame], part: set[int], edges: list[JoinPred]) -> DataFrame:
    """The rows of one part of the join graph: whatever links the next binding to those joined
    already is one composite join."""
    todo = [j for j in edges if j.left.binding in part]
    start = todo[0].left.binding if todo else min(part)
    done, df = {start}, scans[start]
    while todo:
        nxt = next(j for j in todo if (j.left.binding in done) != (j.right.binding in done))
        new = nxt.right.binding if nxt.left.binding in done else nxt.left.binding
        on = [j for j in todo if new in (j.left.binding, j.right.binding) and {j.left.binding, j.right.binding} <= done | {new}]
        df = R.equi_join(df, scans[new], on)
        done.add(new)
        todo = [j for j in todo if j not in on]
    return df


def _multiplies(catalog, q: Query, links: dict[frozenset, list[JoinPred]]) -> bool:
    """Whether a join may have more rows than either side: no declared key is among its columns on
    one side or the other."""
    for link, on in links.items():
        if not any(catalog.unique(q.relations[b], {c.column for j in on for c in (j.left, j.right) if c.binding == b}) for b in link):
            return True
    return False


def _folded(scans: dict[int, DataFrame], part: set[int], links: dict[frozenset, list[JoinPred]], wanted: list[Col]) -> DataFrame:
    """One weighed row of a part whose links are a tree: sides are weighed by their join columns and
    folded into each other from the leaves on, so no join's rows come into being."""

    def down(b: int, above: int | None) -> DataFrame:
        near = {next(iter(link - {b})): on for link, on in links.items() if b in link}
        cols = lambda on: sorted({c.name for j in on for c in (j.left, j.right) if c.binding == b})
        keys = {n: cols(on) for n, on in near.items()}
        side = R.weigh(scans[b], sorted({c for k in keys.values() for c in k}), [c.name for c in wanted if c.binding == b])
        below = [n for n in near if n != above]
        for i, n in enumerate(below):
            left = sorted({c for m in [*below[i + 1 :], *([above] if above is not None else [])] for c in keys[m]})
            side = R.fold(side, down(n, b), near[n], left)
        return side

    return down(min(part), None)


def build(catalog, query: Query | str, result: str = "u64", strict: bool = False) -> DataFrame:
    """The query's single-row result (columns s0..sN).

    Filters go onto the scans, and predicates within one binding become row filters there. A part
    of the join graph that is a tree with a many-to-many join is folded: counts and partial sums per
    join key meet instead of rows. Other parts are joined: along declared keys no join grows, and
    Catalyst's broadcasts are cheaper there than an aggregate at every step; cycles need the rows.
    Parts that nothing links are multiplied as in SQL (with a warning) by their counts alone, or
    rejected when ``strict``.
    """
    q = dedupe_selections(parse_query(query) if isinstance(query, str) else query)
    for c in q.columns():
        width = catalog.width(q.relations[c.binding])
        if c.column >= width:
            raise QueryError(f"column {c}: relation {q.relations[c.binding]} has {width} columns")
    parts = components(q)
    if len(parts) > 1:
        if strict:
            raise QueryError("the join graph falls apart")
        log.warning("bindings %s are not joined: their product is taken", parts)

    scans = {}
    for b, r in enumerate(q.relations):
        own = [f for f in q.filters if f.col.binding == b]
        df = R.scan(catalog.narrowed(r, own), b, catalog.width(r))
        for f in own:
            df = R.filter_constant(df, f, catalog.non_negative(r, f.col.column))
        for j in q.joins:
            if j.left.binding == j.right.binding == b and j.left != j.right:
                df = R.filter_equal(df, j.left, j.right)
        scans[b] = df

    edges = [j for j in q.joins if j.left.binding != j.right.binding]
    weighed = []
    for part in parts:
        links: dict[frozenset, list[JoinPred]] = {}
        for j in edges:
            if j.left.binding in part:
                links.setdefault(frozenset((j.left.binding, j.right.binding)), []).append(j)
        wanted = [c for c in q.selections if c.binding in part]
        if len(links) == len(part) - 1 and links and _multiplies(catalog, q, links):
            weighed.append(_folded(scans, part, links, wanted))
        elif len(parts) == 1:
            return R.checksum(_joined(scans, part, edges), [c.name for c in q.selections], q.output_map(), result)
        else:
            weighed.append(R.weigh(_joined(scans, part, edges), [], [c.name for c in wanted]))
    return R.outputs(R.multiply(weighed), [c.name for c in q.selections], q.output_map(), result)
