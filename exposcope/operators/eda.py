"""Exploratory aggregates (H1, H2, H4-H12) and sort / top-k / union.

Each chart of the published analysis becomes the table behind it.  Grouped
statistics are computed with partial aggregation (map-side combine) first;
per-group parameters (min / max / quartiles) live in a table with one row per
group that ``attach`` broadcasts after counting it, or joins on salted keys,
so a hot group never funnels its rows into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposcope.functions.columns import risk_label
from exposcope.operators.joins import attach, running_count
from exposcope.operators.quantiles import quantiles_of_counts
from exposcope.session import cut_lineage
from exposcope.schema import RISK_LABELS


def risk_distribution(df: DataFrame, col: str = "risk_score") -> DataFrame:
    """H1: count and % per risk level, all five levels present (absent -> 0)."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(col) == i).alias(f"c{i}") for i in range(len(RISK_LABELS))])
    parts = ", ".join(f"{i}, c{i}" for i in range(len(RISK_LABELS)))
    long = agg.selectExpr("__n", f"stack({len(RISK_LABELS)}, {parts}) AS (risk_score, count)")
    return long.select(F.col("risk_score").cast("int").alias("risk_score"),
                       risk_label(F.col("risk_score")).alias("risk_label"), "count",
                       F.when(F.col("__n") == 0, 0.0).otherwise(F.col("count") * 100.0 / F.col("__n"))
                       .alias("pct"))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """H2: count and % per value (percentages over the grouped table only)."""
    g = cut_lineage(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    total = g.agg(F.sum("count")).first()[0]
    return g.withColumn("pct", F.col("count") * 100.0 / F.lit(total))


def histogram_by(df: DataFrame, feat: str, by: Sequence[str] = ("risk_score",),
                 bins: int = 40) -> DataFrame:
    """H4: equal-width histogram between each group's own min and max (last bin
    closed); null groups are a group, null values are skipped."""
    by = list(by)
    x = F.col(feat).cast("double")
    base = df.where(x.isNotNull()).select(*by, x.alias("__x"))
    st = base.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    d = attach(base, st, by)
    w = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    g = d.groupBy(*by, b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
    return g.select(*by, "bin", (F.col("__lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("__lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "count")


def correlation_matrix(df: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """H5: Pearson r for every pair (lower triangle incl. diagonal), pairwise
    complete like pandas.

    A cheap first pass counts nulls and takes the mean per column; sums are of
    values centred on that mean, so large means don't cancel.  Pairs of gap-free
    columns then share plain sums (n, sum x, sum x^2, sum xy); only pairs touching a
    column with gaps get their own conditional sums.  The aggregation buffer
    stays near k + k(k+1)/2 slots instead of 6 per pair, and r follows in
    closed form on the one-row result.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
             if (j <= i if lower else True)]
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(cols)],
                 *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    gaps = {c for i, c in enumerate(cols) if row[f"g{i}"]}
    x = {c: F.col(c).cast("double") - F.lit(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
    aggs: dict[str, Column] = {"n": F.count(F.lit(1)).cast("double")}
    idx = {c: i for i, c in enumerate(cols)}
    moments = []
    for a, b in pairs:
        ia, ib = idx[a], idx[b]
        lo, hi = sorted((ia, ib))
        if a not in gaps and b not in gaps:
            aggs.setdefault(f"s{ia}", F.sum(x[a]))
            aggs.setdefault(f"s{ib}", F.sum(x[b]))
            aggs.setdefault(f"q{ia}", F.sum(x[a] * x[a]))
            aggs.setdefault(f"q{ib}", F.sum(x[b] * x[b]))
            aggs.setdefault(f"p{lo}_{hi}", F.sum(x[a] * x[b]))
            moments.append(("n", f"s{ia}", f"s{ib}", f"q{ia}", f"q{ib}", f"p{lo}_{hi}"))
        else:
            both = x[a].isNotNull() & x[b].isNotNull()
            k = f"{lo}_{hi}"
            aggs.setdefault(f"cn{k}", F.count_if(both).cast("double"))
            aggs.setdefault(f"cs{ia}_{k}", F.sum(F.when(both, x[a])))
            aggs.setdefault(f"cs{ib}_{k}", F.sum(F.when(both, x[b])))
            aggs.setdefault(f"cq{ia}_{k}", F.sum(F.when(both, x[a] * x[a])))
            aggs.setdefault(f"cq{ib}_{k}", F.sum(F.when(both, x[b] * x[b])))
            aggs.setdefault(f"cp{k}", F.sum(F.when(both, x[a] * x[b])))
            moments.append((f"cn{k}", f"cs{ia}_{k}", f"cs{ib}_{k}", f"cq{ia}_{k}", f"cq{ib}_{k}",
                            f"cp{k}"))
    agg = df.agg(*[e.alias(name) for name, e in aggs.items()])
    parts = ", ".join(f"'{a}', '{b}', " + ", ".join(f"`{m}`" for m in mo)
                      for (a, b), mo in zip(pairs, moments))
    long = agg.selectExpr(f"stack({len(pairs)}, {parts}) AS (feature_a, feature_b, n, sa, sb, "
                          f"saa, sbb, sab)")
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    cov = n * F.col("sab") - sa * sb
    va = n * F.col("saa") - sa * sa
    vb = n * F.col("sbb") - sb * sb
    r = F.when((va <= 0) | (vb <= 0) | (n < 2), F.lit(float("nan"))).otherwise(
        F.when(F.col("feature_a") == F.col("feature_b"), F.lit(1.0))
        .otherwise(cov / F.sqrt(va * vb)))
    return long.select("feature_a", "feature_b", F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
                       .alias("r"))


def box_stats(df: DataFrame, feat: str, by: Sequence[str] = ("risk_score",),
              k: float = 1.5) -> DataFrame:
    """H6: quartiles, whiskers (extreme points inside the 1.5 IQR fences) and
    outlier count per group."""
    by = list(by)
    x = F.col(feat).cast("double")
    # the only pass over the rows: (group, value, count)
    counts = cut_lineage(df.where(x.isNotNull()).groupBy(*by, x.alias("v")).agg(F.count(F.lit(1)).alias("c")))
    q = quantiles_of_counts(counts, by, [0.25, 0.5, 0.75]).select(
        *by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    lo = F.col("q1") - k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= lo) & (F.col("v") <= hi)
    return attach(counts, q, by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"))


def density_by(df: DataFrame, feat: str, by: Sequence[str] = ("risk_score",),
               grid: int = 100, cut: float = 2.0) -> DataFrame:
    """H7: Gaussian kernel density per group on a ``grid``-point support.

    Scott bandwidth (n^(-1/5) x sample std), support from min - cut*bw to
    max + cut*bw.  Rows are first compressed exactly to (group, value, count),
    then each distinct value adds its kernel to the fixed-size grid of its
    group: work is linear in distinct values, never pairwise between rows.
    """
    by = list(by)
    x = F.col(feat).cast("double")
    base = df.where(x.isNotNull())
    # the only pass over the rows: exact compression to (group, value, count)
    vals = base.groupBy(*by, x.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # reused three times below: write it once to the shared checkpoint folder
    vals = cut_lineage(vals)
    # moments from the compressed table (two-pass variance, exact in counts)
    m1 = vals.groupBy(*by).agg(F.sum("__c").alias("__n"),
                               (F.sum(F.col("__c") * F.col("__v")) / F.sum("__c")).alias("__mean"),
                               F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    m2 = attach(vals, m1, by).groupBy(*by, "__n", "__mean", "__lo", "__hi").agg(
        F.sum(F.col("__c") * (F.col("__v") - F.col("__mean")) * (F.col("__v") - F.col("__mean")))
        .alias("__ss"))
    st = m2.withColumn("__sd", F.when(F.col("__n") > 1,
                                      F.sqrt(F.col("__ss") / (F.col("__n") - 1))))
    st = st.withColumn("__bw", F.col("__sd") * F.pow(F.col("__n").cast("double"), -0.2))
    st = st.withColumn("__g0", F.col("__lo") - cut * F.col("__bw")).withColumn(
        "__step", (F.col("__hi") - F.col("__lo") + 2 * cut * F.col("__bw")) / (grid - 1))
    d = attach(vals, st, by).where(F.col("__bw") > 0)
    norm = 1.0 / math.sqrt(2 * math.pi)
    e = d.select(*by, "__v", "__c", "__n", "__bw", "__g0", "__step",
                 F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    z = (F.col("__g0") + F.col("i") * F.col("__step") - F.col("__v")) / F.col("__bw")
    e = e.withColumn("__k", F.col("__c") * F.exp(-0.5 * F.pow(z, 2)))
    g = e.groupBy(*by, "i", "__n", "__bw", "__g0", "__step").agg(F.sum("__k").alias("__sum"))
    return g.select(*by, "i", (F.col("__g0") + F.col("i") * F.col("__step")).alias("x"),
                    (F.col("__sum") * norm / (F.col("__n") * F.col("__bw"))).alias("density"))


#: Kernels are cut off at this many bandwidths, where a Gaussian is below 1e-14 of its peak.
KERNEL_REACH = 8.0


def binned_density(df: DataFrame, feat: str, by: Sequence[str] = ("risk_score",), grid: int = 100,
                   cut: float = 2.0, bins: int = 1024) -> DataFrame:
    """H7 for columns of any number of distinct values: linear binning, then the kernel
    on the bins.  Support, bandwidth and columns are those of ``density_by``.

    A value between two of the group's ``bins`` equally spaced points adds its distance
    to one as weight to the other, so rows are summed to at most groups x bins weights
    before the shuffle; the kernel then costs groups x bins x grid, whatever the rows.
    With d the distance of two points and h the bandwidth, a density is off by at
    most d^2 / (8 h^2) x 0.4 / h (linear interpolation of the kernel), and by 1e-14 of
    a peak for the cut-off.  Groups without spread have no density, as there.
    """
    by = list(by)
    x = F.col(feat).cast("double")
    base = df.where(x.isNotNull()).select(*by, x.alias("__v"))
    n = F.count(F.lit(1))
    st = base.groupBy(*by).agg(n.alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                               (F.stddev_samp("__v") * F.pow(n.cast("double"), F.lit(-0.2))).alias("__bw"))
    st = cut_lineage(st.where("__bw > 0")).withColumn("__d", (F.col("__hi") - F.col("__lo")) / (bins - 1))
    at = (F.col("__v") - F.col("__lo")) / F.col("__d")
    rows = attach(base, st, by).withColumn("__at", F.least(at, F.lit(float(bins - 1))))
    low = F.floor("__at")
    sides = F.array(F.struct(low.alias("j"), (low + 1 - F.col("__at")).alias("w")),
                    F.struct((low + 1).alias("j"), (F.col("__at") - low).alias("w")))
    params = ["__n", "__lo", "__hi", "__bw", "__d"]
    weights = rows.select(*by, *params, F.explode(sides).alias("s")).where("s.w > 0") \
        .groupBy(*by, *params, F.col("s.j").alias("j")).agg(F.sum("s.w").alias("w"))
    g0 = F.col("__lo") - cut * F.col("__bw")
    step = (F.col("__hi") - F.col("__lo") + 2 * cut * F.col("__bw")) / (grid - 1)
    points = weights.select(*by, "__n", "__bw", "w", (F.col("__lo") + F.col("j") * F.col("__d")).alias("b"), g0.alias("g0"), step.alias("step"),
                            F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    z = (F.col("g0") + F.col("i") * F.col("step") - F.col("b")) / F.col("__bw")
    part = F.when(F.abs(z) <= KERNEL_REACH, F.col("w") * F.exp(-0.5 * z * z)).otherwise(F.lit(0.0))
    total = points.select(*by, "i", "__n", "__bw", "g0", "step", part.alias("k")).groupBy(*by, "i", "__n", "__bw", "g0", "step") \
        .agg(F.sum("k").alias("k"))
    return total.select(*by, "i", (F.col("g0") + F.col("i") * F.col("step")).alias("x"),
                        (F.col("k") / (math.sqrt(2 * math.pi) * F.col("__n") * F.col("__bw"))).alias("density"))


def violin(df: DataFrame, feat: str, by: Sequence[str] = ("risk_score",), grid: int = 100, cut: float = 2.0,
           bins: int = 1024) -> DataFrame:
    """H7: ``binned_density`` with each group's quartiles (q1, median, q3)."""
    from exposcope.operators.quantiles import grouped_quantiles
    q = grouped_quantiles(df, list(by), feat, [0.25, 0.5, 0.75]).select(
        *by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    return attach(binned_density(df, feat, by, grid, cut, bins), q, by)

def density_2d(df: DataFrame, x: str, y: str, z: str = "risk_score", nx: int = 20,
               ny: int = 20) -> DataFrame:
    """H8: scatter as a 2-D binned density with the mean of ``z`` per cell."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    row = df.agg(F.min(xs).alias("x0"), F.max(xs).alias("x1"),
                 F.min(ys).alias("y0"), F.max(ys).alias("y1")).first()
    if row is None or row["x0"] is None or row["y0"] is None:
        return df.where(F.lit(False)).select(F.lit(0).alias("bin_x"), F.lit(0).alias("bin_y"),
                                  F.lit(0).cast("long").alias("count"),
                                  F.lit(0.0).alias(f"mean_{z}"))

    def binexpr(c, lo, hi, n):
        if hi == lo:
            return F.lit(0)
        return F.least(F.floor((c - F.lit(lo)) / F.lit((hi - lo) / n)), F.lit(n - 1)).cast("int")

    return (df.where(xs.isNotNull() & ys.isNotNull())
            .groupBy(binexpr(xs, row["x0"], row["x1"], nx).alias("bin_x"),
                     binexpr(ys, row["y0"], row["y1"], ny).alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(z).alias(f"mean_{z}")))


def mean_risk_by(df: DataFrame, col: str, value: str = "risk_score") -> DataFrame:
    """Mean risk per value of ``col``, ascending."""
    return df.groupBy(col).agg(F.avg(value).alias("mean_risk")).orderBy("mean_risk", col)


def sample_key(key: str, seed: int = 42):
    """Engine-independent pseudo-random order: md5('<seed>-<key>')."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Fixed-size pseudo-random sample (top-n by hash, no full sort)."""
    return df.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def pair_sample(df: DataFrame, cols: Sequence[str], n: int = 3000, seed: int = 42,
                key: str = "event_id", label: str = "risk_score") -> DataFrame:
    """H9: the pair-plot rows: a fixed-size sample of a few features + label."""
    return sample_n(df, n, seed, key).select(key, *cols, label)


def crosstab_pct(df: DataFrame, row: str, col: str = "risk_score",
                 values: Sequence = tuple(range(5)), names: Sequence[str] = RISK_LABELS) -> DataFrame:
    """Shares of ``values`` among all rows of each ``row`` value, in %; rows
    with another value (or none) count in the total, so what is missing to 100
    is theirs."""
    hit = [F.count_if(F.col(col) == v).alias(f"__{i}") for i, v in enumerate(values)]
    return df.groupBy(row).agg(F.count(F.lit(1)).alias("__n"), *hit).select(
        row, *[(F.col(f"__{i}") * 100.0 / F.col("__n")).alias(f"pct_{nm}") for i, nm in enumerate(names)])


def sort_events(df: DataFrame, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events in time order (range-partitioned global sort)."""
    return df.orderBy(ts, key)


def with_position(ordered: DataFrame, out: str = "position") -> DataFrame:
    """The place (from 1) of each row in the order that ``ordered`` has: row
    numbers inside partitions, shifted by the sizes of earlier partitions."""
    at = ordered.withColumn("__at", F.monotonically_increasing_id()).withColumn("__one", F.lit(1))
    return running_count(cut_lineage(at), [], "__at", "__one", out) \
        .withColumn(out, F.col(out) + 1).drop("__at", "__one")


def top_k(df: DataFrame, col: str, k: int, key: str | None = None) -> DataFrame:
    """K rows with the largest ``col`` (ties by ``key``)."""
    order = [F.col(col).desc()] + ([F.col(key)] if key else [])
    return df.orderBy(*order).limit(k)


def union_events(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side come back null."""
    return a.unionByName(b, allowMissingColumns=True)
