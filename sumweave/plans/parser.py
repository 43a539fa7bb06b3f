"""The compact query line: ``relations|predicates|selections``."""

from __future__ import annotations

import re

from sumweave.functions.u64 import MOD
from sumweave.plans.model import Col, Filter, JoinPred, Query

_UINT = re.compile(r"\d+", re.ASCII)
_COL = re.compile(r"(\d+)\.(\d+)", re.ASCII)
_PRED = re.compile(r"(\d+)\.(\d+)([<>=])(\d+)(?:\.(\d+))?", re.ASCII)


class QueryError(ValueError):
    """The line is no valid query."""


def _id(text: str) -> int:
    if not _UINT.fullmatch(text) or (n := int(text)) >= 1 << 32:
        raise QueryError(f"no 32-bit id: {text!r}")
    return n


def parse_column(text: str) -> Col:
    if not (m := _COL.fullmatch(text)):
        raise QueryError(f"no column: {text!r}")
    return Col(_id(m[1]), _id(m[2]))


def parse_predicate(text: str) -> JoinPred | Filter:
    """``b.c=b.c`` joins, ``b.c{<,>,=}constant`` filters. Columns compare by equality only."""
    if not (m := _PRED.fullmatch(text)):
        raise QueryError(f"no predicate: {text!r}")
    left = Col(_id(m[1]), _id(m[2]))
    if m[5] is not None:
        if m[3] != "=":
            raise QueryError(f"columns can be compared with = only: {text!r}")
        return JoinPred(left, Col(_id(m[4]), _id(m[5])))
    if int(m[4]) >= MOD:
        raise QueryError(f"constant beyond 64 bits: {text!r}")
    return Filter(left, m[3], int(m[4]))


def parse_query(line: str) -> Query:
    """Parse one line; raises :class:`QueryError` on anything outside the grammar."""
    parts = line.strip("\r\n").split("|")
    if len(parts) != 3:
        raise QueryError(f"three parts are needed, not {len(parts)}: {line!r}")
    relations = tuple(_id(x) for x in parts[0].split())
    preds = [parse_predicate(x.strip()) for x in parts[1].split("&")] if parts[1].strip() else []
    selections = tuple(parse_column(x) for x in parts[2].split())
    if not relations or not selections:
        raise QueryError(f"no relation or no selection: {line!r}")
    q = Query(relations, tuple(p for p in preds if isinstance(p, JoinPred)), tuple(p for p in preds if isinstance(p, Filter)), selections)
    for c in q.columns():
        if c.binding >= len(relations):
            raise QueryError(f"column {c}: there are {len(relations)} bindings")
    return q
