"""Exact quantiles with bounded memory (linear interpolation, as pandas/numpy).

Global quantiles are radix selection on order-preserving 64-bit keys: the bits of a
double, flipped so that keys sort as values do.  Each pass counts, for every still
open (column, rank), the keys of its interval in BUCKETS buckets of a power of two
wide, with each bucket's least and greatest key, and keeps the bucket that holds
the rank.  An interval loses 11 bits a pass and the first holds all keys (its
buckets are powers of two), so that at most 6 passes find any rank, however values are
spread; a bucket with one distinct value ends a search at once.  Whatever the data size, a pass shuffles and
returns at most BUCKETS rows per open rank.  There is one path for all sizes.

Grouped quantiles compress rows to (group, value, count) and read the order
statistics off exact running counts.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposcope.operators.joins import attach, running_count
from exposcope.session import ship_package

BUCKETS = 2048
_LOW63 = (1 << 63) - 1


def to_key(v: float) -> int:
    """A signed 64-bit number that sorts as ``v`` does (0.0 and -0.0 are one)."""
    bits = struct.unpack("<q", struct.pack("<d", v + 0.0))[0]
    return bits if bits >= 0 else bits ^ _LOW63


def from_key(k: int) -> float:
    return struct.unpack("<d", struct.pack("<q", k if k >= 0 else k ^ _LOW63))[0]


def _keys(column: pa.Array) -> np.ndarray:
    """Keys of the values of a double column, nulls and NaN left out."""
    v = np.asarray(column.drop_null(), np.float64)
    bits = (v[~np.isnan(v)] + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(_LOW63))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    extra: Sequence | None = None, buckets: int = BUCKETS) -> dict:
    """{column: [quantile for each prob]} over the non-null, non-NaN values of each
    column; all None for a column without values.  ``extra`` aggregate columns
    are computed in the first pass and returned under ``"__extra"``."""
    cols, probs, extra = list(cols), list(probs), list(extra or [])
    if not cols and not extra:
        return {}
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    found: dict[tuple[int, int], float] = {}
    # the first count covers all keys, or the range that a pass for ``extra`` tells anyway
    first, spans = {}, [(i, -_LOW63 - 1, _LOW63) for i in range(len(cols))]
    if extra:
        first = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(x[c]).alias(f"__qlo{i}"), F.max(x[c]).alias(f"__qhi{i}"))],
                       *extra).first().asDict()
        spans = [(i, to_key(first[f"__qlo{i}"]), to_key(first[f"__qhi{i}"])) for i in range(len(cols)) if first[f"__qlo{i}"] is not None]
    out: dict = {"__extra": {k: v for k, v in first.items() if not k.startswith("__q")}}
    got = _count(df, x, cols, spans, buckets) if spans else {}
    table = {i: got.get(s, []) for s, (i, _, _) in enumerate(spans)}
    size = [sum(r["n"] for r in table.get(i, [])) for i in range(len(cols))]
    # open searches: (column, rank) -> (least key, greatest key, rows below)
    search: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, n in enumerate(size):
        for p in probs if n else []:
            k = math.floor(p * (n - 1))
            for r in {k, min(k + 1, n - 1)}:
                search[i, r] = _bucket_of(r, table[i], 0)
    while True:
        for key in [k for k, (lo, hi, _) in search.items() if lo == hi]:
            found[key] = from_key(search.pop(key)[0])
        if not search:
            break
        search = _narrow(df, x, cols, search, buckets)
    for i, c in enumerate(cols):
        n, vals = size[i], []
        for p in probs:
            if not n:
                vals.append(None)
                continue
            pos = p * (n - 1)
            k = math.floor(pos)
            a, b = found[i, k], found[i, min(k + 1, n - 1)]
            vals.append(a + (b - a) * (pos - k) if pos != k else a)
        out[c] = vals
    return out


def _bucket_of(rank, rows, below):
    """(least key, greatest key, rows below) of the bucket that holds ``rank``."""
    for r in rows:
        if rank < below + r["n"]:
            return r["lo"], r["hi"], below
        below += r["n"]
    raise RuntimeError("values changed between passes")


def _narrow(df, x, cols, search, buckets):
    """One counting pass: every open search moves to the bucket that holds its rank."""
    spans = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in search.items()})
    table = _count(df, x, cols, spans, buckets)
    return {(i, rank): _bucket_of(rank, table.get(spans.index((i, lo, hi)), []), below)
            for (i, rank), (lo, hi, below) in search.items()}


def _count(df, x, cols, spans, buckets):
    """{number of a span: its buckets that hold keys, ascending, with count, least and
    greatest key}; a span is (column, least key, greatest key)."""
    ship_package(df.sparkSession)
    used = sorted({i for i, _, _ in spans})
    shifts = []
    for _, lo, hi in spans:
        shift = 0
        while (hi - lo) >> shift >= buckets:
            shift += 1
        shifts.append(shift)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), buckets), np.int64)
        least, most = np.full(n.shape, _LOW63, np.int64), np.full(n.shape, -_LOW63 - 1, np.int64)
        for b in batches:
            keys = {i: np.sort(_keys(b.column(k))) for k, i in enumerate(used)}
            for s, ((i, lo, hi), shift) in enumerate(zip(spans, shifts)):
                k = keys[i][np.searchsorted(keys[i], lo):np.searchsorted(keys[i], hi, side="right")]
                if not len(k):
                    continue
                with np.errstate(over="ignore"):  # the distance from lo, as an unsigned number
                    at = (k.view(np.uint64) - np.array(lo, np.int64).view(np.uint64)) >> np.uint64(shift)
                ends = np.append(np.flatnonzero(at[1:] != at[:-1]), len(k) - 1)
                starts = np.append(0, ends[:-1] + 1)
                mine = at[starts].astype(np.int64)
                n[s, mine] += ends - starts + 1
                least[s, mine] = np.minimum(least[s, mine], k[starts])
                most[s, mine] = np.maximum(most[s, mine], k[ends])
        s, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(at, pa.int32()), pa.array(n[s, at]),
                                          pa.array(least[s, at]), pa.array(most[s, at])], names=["s", "b", "n", "lo", "hi"])

    rows = (df.select(*[x[cols[i]].alias(f"x{i}") for i in used]).mapInArrow(count, "s int, b int, n bigint, lo bigint, hi bigint")
            .groupBy("s", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .collect())  # at most ``buckets`` rows per open search
    table: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["s"], r["b"])):
        table.setdefault(r["s"], []).append(r)
    return table


def grouped_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Exact per-group quantiles, one row per group with ``n`` and ``q0, q1, ...``;
    null groups are groups, null values are skipped."""
    x = F.col(col).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return quantiles_of_counts(counts, by, probs)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The same from a (group, ``v``, ``c``) table of value counts."""
    by, probs = list(by), list(probs)
    size = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    run = attach(running_count(counts, by, "v", "c"), size, by)
    picks = []
    for j, p in enumerate(probs):
        k = F.floor(F.lit(p) * (F.col("n") - 1))
        for r, name in ((k, "a"), (F.least(k + 1, F.col("n") - 1), "b")):
            hit = (F.col("before") <= r) & (r < F.col("before") + F.col("c"))
            picks.append(F.min(F.when(hit, F.col("v"))).alias(f"{name}{j}"))
    got = run.groupBy(*by, "n").agg(*picks)

    def q(j, p):
        pos = F.lit(p) * (F.col("n") - 1)
        frac = pos - F.floor(pos)
        return F.when(frac == 0, F.col(f"a{j}")).otherwise(
            F.col(f"a{j}") + (F.col(f"b{j}") - F.col(f"a{j}")) * frac).alias(f"q{j}")

    return got.select(*by, "n", *[q(j, p) for j, p in enumerate(probs)])
