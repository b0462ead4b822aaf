"""Small column expressions shared by operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposcope.schema import RISK_LABELS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip into [lo, hi]; null stays null."""
    out = _col(c)
    if lo is not None:
        out = F.when(out.isNull(), None).otherwise(F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(out.isNull(), None).otherwise(F.least(out, F.lit(hi)))
    return out


def lookup(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Map a value through a literal dict; unknown (and null) -> default."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[_col(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def ordinal_code(c: str | Column, order: Sequence[str]) -> Column:
    """Position of the value in ``order`` as int; unknown or null -> null."""
    return lookup(c, {v: i for i, v in enumerate(order)}).cast("int")


def risk_label(c: str | Column) -> Column:
    """Risk level 0..4 -> its name; anything else -> null."""
    return ordinal_name(c, RISK_LABELS)


def ordinal_name(c: str | Column, names: Sequence[str]) -> Column:
    return lookup(c, {i: v for i, v in enumerate(names)})


def display_name(c: str | Column) -> Column:
    """snake_case column name -> 'Snake Case' (Python ``str.title`` on words)."""
    return F.initcap(F.translate(_col(c), "_", " "))


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Keeps expressions that use a sub-expression several times linear in size
    (Catalyst would otherwise inline the sub-expression at every use).
    """
    return F.transform(F.array(expr), fn)[0]


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """Half-to-even rounding of the binary product x * 10^digits.

    Same IEEE operations in every engine, so results are reproducible across
    engines; ties are broken to the even neighbour like Python's ``round``.
    """
    p = float(10 ** digits)

    def rnd(y):
        f = F.floor(y)
        d = y - f
        r = (F.when(d > 0.5, f + 1).when(d < 0.5, f)
             .otherwise(F.when(f % 2 == 0, f).otherwise(f + 1)))
        return (r / p) if digits else r.cast("double")

    return bind(_col(c).cast("double") * p, rnd)


def rounded(c: str | Column, digits: int) -> Column:
    """``F.round`` of a double, to the bit, mostly without its decimal arithmetic: away from
    midpoints and up to 1e9 the nearest whole of x * 10^digits over 10^digits is that double
    (k / 10^digits is correctly rounded); the rest, NaN and infinities too, go to ``F.round``."""
    x, p = _col(c).cast("double"), float(10 ** digits)
    y = x * p
    near = F.rint(y)
    safe = (F.abs(y) < 1e9) & (F.abs(y - near) < 0.499999)
    return F.when(safe, near / p + F.lit(0.0)).otherwise(F.round(x, digits))


def fixed(c: str | Column, digits: int) -> Column:
    """Number as text with ``digits`` (0 to 2) decimals: the double's exact value,
    ties to the even digit, as ``%.<digits>f`` prints it in C and Python.

    x * 10 = x * 8 + x * 2 and x * 100 = x * 64 + x * 32 + x * 4: powers of two
    are exact, and the rounding error of each sum is known, so the comparison
    with the midpoint is exact too.  Sums are bound: written out at every use, a few
    numbers make a method that the JVM does not compile.
    """
    if digits not in (0, 1, 2):
        raise ValueError("0 to 2 digits")

    def nearest(s, err):
        f = F.floor(s)
        above = (s - f) - 0.5
        up = (above > 0) | ((above == 0) & ((err > 0) | ((err == 0) & (f % 2 == 1))))
        return f + F.when(up, 1).otherwise(0)

    def two_sum(a, b, fn):
        def errors(s):
            t = s - a
            return fn(s, (a - (s - t)) + (b - t))
        return bind(a + b, errors)

    def whole(x):
        if digits == 0:
            return nearest(x, F.lit(0.0))
        if digits == 1:
            return two_sum(x * 8.0, x * 2.0, nearest)
        return two_sum(x * 64.0, x * 32.0, lambda h, e1: two_sum(h, x * 4.0, lambda s, e2: nearest(s, e1 + e2)))

    def text(v):
        sign, p = F.when(v < 0, "-").otherwise(""), 10 ** digits
        if digits == 0:
            return F.concat(sign, whole(F.abs(v)).cast("string"))
        return bind(whole(F.abs(v)), lambda n: F.concat(
            sign, F.coalesce(F.floor(n / p).cast("string"), F.lit("null")), F.lit("."),
            F.coalesce(F.lpad((n % p).cast("long").cast("string"), digits, "0"), F.lit("null"))))

    return bind(_col(c).cast("double"), text)
