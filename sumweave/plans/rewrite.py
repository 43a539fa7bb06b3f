"""Plan-time rewrites that Catalyst does not make."""

from __future__ import annotations

from dataclasses import replace

from sumweave.plans.model import Col, Query


def equality_classes(query: Query) -> dict[Col, Col]:
    """Each joined column's representative: the smallest column it is transitively equal to."""
    parent: dict[Col, Col] = {}

    def root(c: Col) -> Col:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for j in query.joins:
        a, b = sorted((root(j.left), root(j.right)))
        parent[b] = a
    return {c: root(c) for c in parent}


def dedupe_selections(query: Query) -> Query:
    """Sum each class of provably equal columns once; ``outputs`` repeats the shared sums."""
    classes = equality_classes(query)
    kept: list[Col] = []
    outputs = []
    for k in query.output_map():
        rep = classes.get(query.selections[k], query.selections[k])
        if rep not in kept:
            kept.append(rep)
        outputs.append(kept.index(rep))
    return replace(query, selections=tuple(kept), outputs=tuple(outputs))


def components(query: Query) -> list[set[int]]:
    """Connected components of the join graph over bindings, in binding order."""
    left = list(range(len(query.relations)))
    for j in query.joins:
        a, b = left[j.left.binding], left[j.right.binding]
        left = [min(a, b) if x in (a, b) else x for x in left]
    return [{b for b, x in enumerate(left) if x == r} for r in sorted(set(left))]
