"""SQL expressions on k-mers of up to 31 bases packed into a long: A, C, G and T are 0 to 3, the first base is the highest
pair of bits, so numbers are in the order of the strings.

``k`` is a number or the name of a column; arguments are SQL text, and so are results.  Up to four neighbours of a node
are the four lanes of one long: 16 bits each, the abundance of the neighbour that has this base, CAP at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_K = 31
CAP = 32767


def bits(k: int | str) -> str:
    """A number with the bits of ``k`` bases set."""
    return f"{(1 << 2 * k) - 1}L" if isinstance(k, int) else f"(shiftleft(1L, 2 * {k}) - 1)"


def less(k: int | str, n: int = 1) -> int | str:
    return k - n if isinstance(k, int) else f"({k} - {n})"


def reverse_complement(x: str, k: int | str) -> str:
    y = f"~({x})"
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        y = f"((shiftrightunsigned({y}, {step}) & {mask}L) | shiftleft({y} & {mask}L, {step}))"
    y = f"(shiftrightunsigned({y}, 32) | shiftleft({y}, 32))"
    return f"shiftrightunsigned({y}, {64 - 2 * k})" if isinstance(k, int) else f"shiftrightunsigned({y}, 64 - 2 * {k})"


def suffix(x: str, k: int | str) -> str:
    """All but the first base."""
    return f"(({x}) & {bits(less(k))})"


def lane(v: str, b: int | str) -> str:
    """The abundance in lane ``b``."""
    return f"cast(shiftrightunsigned({v}, {16 * b if isinstance(b, int) else f'16 * {b}'}) & 65535 as int)"


def degree(v: str, a: str) -> str:
    """Lanes with an abundance of ``a`` or more."""
    return "(" + " + ".join(f"if({lane(v, b)} >= {a}, 1, 0)" for b in range(4)) + ")"


def top(v: str) -> str:
    """The largest lane."""
    return f"greatest({', '.join(lane(v, b) for b in range(4))})"


def second(v: str) -> str:
    """The largest lane but one."""
    p, q, r, s = (lane(v, b) for b in range(4))
    return f"greatest(least({p}, {q}), least({r}, {s}), least(greatest({p}, {q}), greatest({r}, {s})))"


def top_lane(v: str) -> str:
    """The number of the largest lane, of equal ones the first."""
    most = top(v)
    return f"(case {' '.join(f'when {lane(v, b)} = {most} then {b}' for b in range(3))} else 3 end)"


def successor(x: str, b: str, k: int | str) -> str:
    """The k-mer after ``x`` that lane ``b`` of its right end stands for: lanes are numbered from the other strand."""
    return f"(shiftleft({suffix(x, k)}, 2) | (3 - {b}))"


def spelled(x: str, k: int | str) -> Column:
    """The string of a packed k-mer."""
    return F.expr(f"translate(lpad(conv(cast({x} as string), 10, 4), {k}, '0'), '0123', 'ACGT')")


def last_base(x: str) -> Column:
    return F.expr(f"substring('ACGT', cast({x} & 3 as int) + 1, 1)")


def packed(kmer: str) -> Column:
    """The packed number of a string of up to 31 bases."""
    return F.expr(f"cast(conv(translate({kmer}, 'ACGT', '0123'), 4, 10) as long)")


def with_reverse(df: DataFrame, x: str, k: int | str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(reverse_complement(x, k)))
