"""Query model: bindings, predicates, selections, and its text and SQL forms."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True, order=True)
class Col:
    """A column of a FROM entry."""

    binding: int
    column: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.column}"

    @property
    def name(self) -> str:
        return f"b{self.binding}_c{self.column}"


@dataclass(frozen=True)
class Filter:
    col: Col
    op: str
    constant: int

    def __str__(self) -> str:
        return f"{self.col}{self.op}{self.constant}"


@dataclass(frozen=True)
class JoinPred:
    left: Col
    right: Col

    def __str__(self) -> str:
        return f"{self.left}={self.right}"


@dataclass(frozen=True)
class Query:
    relations: tuple[int, ...]
    joins: tuple[JoinPred, ...] = ()
    filters: tuple[Filter, ...] = ()
    selections: tuple[Col, ...] = ()
    #: output position -> position in ``selections``; set by the rewrite
    outputs: tuple[int, ...] = field(default=())

    def columns(self) -> set[Col]:
        return {c for j in self.joins for c in (j.left, j.right)} | {f.col for f in self.filters} | set(self.selections)

    def output_map(self) -> tuple[int, ...]:
        return self.outputs or tuple(range(len(self.selections)))

    def to_text(self) -> str:
        """The line form: join predicates first, then filters."""
        return "|".join((" ".join(map(str, self.relations)), "&".join(map(str, (*self.joins, *self.filters))), " ".join(map(str, self.selections))))

    def to_sql(self, dialect: str = "duckdb", prefix: str = "r", total=None) -> str:
        """An equivalent SELECT over views ``r<id>``; outputs are named s0..sN.

        ``total(expr)`` builds the aggregate text; by default NULLIF(SUM(expr), 0) as BIGINT.
        Constants and order are unsigned, columns hold the bits as BIGINT.
        """
        from sumweave.functions.u64 import TOP, signed

        q = {"duckdb": '"', "spark": "`"}[dialect]
        total = total or (lambda x: f"CAST(NULLIF(SUM({x}), 0) AS BIGINT)")
        name = lambda c: f"{q}{c.binding}{q}.c{c.column}"

        def where(f: Filter) -> str:
            x, c, high = name(f.col), signed(f.constant), f.constant >= TOP
            if f.op == "=":
                return f"{x} = {c}"
            if f.op == ">":
                return f"({x} < 0 AND {x} > {c})" if high else f"({x} < 0 OR {x} > {c})"
            return f"({x} >= 0 OR {x} < {c})" if high else f"({x} >= 0 AND {x} < {c})"

        outs = ", ".join(f"{total(name(self.selections[k]))} AS s{i}" for i, k in enumerate(self.output_map()))
        tables = ", ".join(f"{prefix}{r} {q}{b}{q}" for b, r in enumerate(self.relations))
        conds = [f"{name(j.left)} = {name(j.right)}" for j in self.joins] + [where(f) for f in self.filters]
        return f"SELECT {outs} FROM {tables}" + (" WHERE " + " AND ".join(conds) if conds else "")
