"""Unsigned 64-bit semantics over Spark's signed BIGINT (bit patterns kept as is).

Equality and join keys need nothing: equal bits are equal numbers. Ordered comparison with a
constant splits on the sign bit, and sums are taken modulo 2**64 from sums of 22-bit pieces, so no
row is widened to a decimal and ANSI overflow cannot occur below 2**41 rows. Sums that are combined
further (counts and partial sums of a join's sides) are DECIMAL(20,0) between 0 and 2**64 - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 63
MOD = 1 << 64
#: Bits to a piece of a sum: n rows' pieces stay below n * 2**PIECE.
PIECE = 22


def signed(value: int) -> int:
    """The BIGINT with the bits of an unsigned value."""
    if not 0 <= value < MOD:
        raise ValueError(f"{value} is no unsigned 64-bit number")
    return value - MOD if value >= TOP else value


def unsigned(value: int) -> int:
    """The unsigned value with the bits of a BIGINT."""
    return value + MOD if value < 0 else value


def compare(col: Column, op: str, constant: int, non_negative: bool = False) -> Column:
    """``col op constant`` in unsigned order. With ``non_negative`` (statistics prove every value
    below 2**63) the plain comparison is returned, which Parquet can push down whole."""
    c = F.lit(signed(constant)).cast("bigint")
    if op == "=":
        return col == c
    if op not in "<>":
        raise ValueError(f"no such comparison: {op}")
    high = constant >= TOP
    if non_negative:
        return F.lit(op == "<") if high else (col > c if op == ">" else col < c)
    if op == ">":
        return (col < 0) & (col > c) if high else (col < 0) | (col > c)
    return (col >= 0) | (col < c) if high else (col >= 0) & (col < c)


def ranges(op: str, constant: int) -> list[tuple[int | None, int | None]]:
    """The BIGINTs (inclusive bounds, None for open) whose unsigned values stand so to a constant."""
    c = signed(constant)
    if op == "=":
        return [(c, c)]
    if op == ">":
        return [(c + 1, -1)] if c < 0 else [(c + 1, None), (None, -1)]
    return [(0, None), (None, c - 1)] if c < 0 else [(0, c - 1)]


def ordered(col: Column) -> Column:
    """A signed BIGINT whose order is the unsigned order of ``col``."""
    return col.bitwiseXOR(F.lit(-TOP).cast("bigint"))


def unordered(col: Column) -> Column:
    """The inverse of :func:`ordered`."""
    return ordered(col)


def sum_pieces(col: str) -> list[str]:
    """SQL of the aggregates :func:`sum_from_pieces` puts together: one for each PIECE bits of a
    column, lowest first (the highest piece has what is left of them)."""
    return [f"sum(shiftrightunsigned({col}, {k}) & {(1 << PIECE) - 1}L)" for k in range(0, 64, PIECE)]


def modular(total: str) -> str:
    """SQL of a decimal total mod 2**64 as DECIMAL(20,0)."""
    return f"CAST(pmod({total}, {MOD}BD) AS DECIMAL(20,0))"


def value_from_pieces(pieces: list[str]) -> str:
    """SQL of a DECIMAL(20,0): the pieces' sums put in their places, mod 2**64; null for no rows. A
    sum below 2**63 in the highest place stays below 2**107, within DECIMAL(38,0)."""
    return modular(" + ".join(f"CAST(CAST({p} AS DECIMAL(19,0)) * {1 << PIECE * k}BD AS DECIMAL(38,0))" for k, p in enumerate(pieces)))


def sum_from_pieces(pieces: list[str]) -> str:
    """The same with null for zero."""
    return zero_as_null(value_from_pieces(pieces))


def zero_as_null(value: str) -> str:
    return f"nullif({value}, CAST(0 AS DECIMAL(20,0)))"


def product(a: str, b: str) -> str:
    """SQL of the product mod 2**64 of two DECIMAL(20,0) values between 0 and 2**64 - 1, from 32-bit halves."""
    half = 1 << 32
    low = lambda x: f"CAST(pmod({x}, {half}BD) AS DECIMAL(10,0))"
    high = lambda x: f"CAST({x} div {half}BD AS DECIMAL(10,0))"
    cross = f"CAST(pmod({high(a)} * {low(b)} + {low(a)} * {high(b)}, {half}BD) AS DECIMAL(10,0))"
    return modular(f"{low(a)} * {low(b)} + {cross} * {half}BD")


def as_bigint(total: str) -> str:
    """SQL of the modular sum's bits as BIGINT (two's complement)."""
    return f"CAST(CASE WHEN {total} >= {TOP}BD THEN {total} - {MOD}BD ELSE {total} END AS BIGINT)"
