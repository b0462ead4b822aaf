"""Outlier fences and flags.

All quartiles of all features are fitted together (the published pipeline
computes them twice per feature) with bounded-memory exact selection; the
fences are then inlined as literals, so flagging rows is a map-only projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposcope.operators.clean import _one_row
from exposcope.schema import OUTLIER_FEATURES


class Fences:
    """Per feature: q1, q3, iqr, lower, upper, mean, sample std, min, max."""

    def __init__(self, stats: dict[str, dict[str, float]], k: float):
        self.stats, self.k = stats, k

    def outside(self, c: str):
        """Strictly outside the fence; null where the value or the fence is."""
        s = self.stats[c]
        x = F.col(c)
        return (x < F.lit(s["lower"]).cast("double")) | (x > F.lit(s["upper"]).cast("double"))


def fit_fences(df: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, k: float = 1.5,
               exact: bool = True) -> Fences:
    """Quartiles (exact order statistics with bounded memory, or approximate),
    mean, sample std, min and max per feature."""
    from exposcope.operators.quantiles import exact_quantiles
    cols = list(cols)
    exprs = []
    for c in cols:
        x = F.col(c).cast("double")
        exprs += [F.avg(x).alias(f"m__{c}"), F.stddev_samp(x).alias(f"s__{c}"),
                  F.min(x).alias(f"lo__{c}"), F.max(x).alias(f"hi__{c}")]
    if exact:
        q = exact_quantiles(df, cols, [0.25, 0.75], extra=exprs)
        row = q["__extra"]
    else:
        r = _one_row(df, [F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], 1000000)
                          .alias(c) for c in cols] + exprs)
        q = {c: r[c] for c in cols}
        row = r
    stats = {}
    for c in cols:
        q1, q3 = q[c]
        iqr = None if q1 is None else q3 - q1  # a column without values has no fence
        stats[c] = {"q1": q1, "q3": q3, "iqr": iqr, "lower": None if iqr is None else q1 - k * iqr,
                    "upper": None if iqr is None else q3 + k * iqr,
                    "mean": row[f"m__{c}"], "std": row[f"s__{c}"],
                    "min": row[f"lo__{c}"], "max": row[f"hi__{c}"]}
    return Fences(stats, k)


def iqr_bounds(df: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, k: float = 1.5) -> DataFrame:
    """Long table feature, q1, q3, iqr, lower, upper."""
    from exposcope.operators.quantiles import exact_quantiles
    cols = list(cols)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    rows = [(c, float(q[c][0]), float(q[c][1])) if q[c][0] is not None else (c, None, None)
            for c in cols]
    # one row per feature: the fitted values are a table of bounded size
    long = df.sparkSession.createDataFrame(rows, "feature string, q1 double, q3 double")
    return (long.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower", F.col("q1") - k * F.col("iqr"))
            .withColumn("upper", F.col("q3") + k * F.col("iqr")))


def outlier_report(df: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, k: float = 1.5,
                   z: float = 3.0, only_flagged: bool = True,
                   fences: Fences | None = None) -> DataFrame:
    """Per feature IQR outlier count (strict), |z| > 3 count (sample std),
    min and max; by default only features with at least one outlier."""
    f = fences or fit_fences(df, cols, k)
    exprs = []
    for c in cols:
        s = f.stats[c]
        sd = s["std"]
        zc = (F.abs((F.col(c) - F.lit(s["mean"])) / F.lit(sd)) > z) if sd else F.lit(False)
        exprs += [F.count_if(f.outside(c)).alias(f"{c}__iqr_outliers"),
                  F.count_if(zc).alias(f"{c}__z_outliers")]
    agg = df.agg(*exprs)
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__iqr_outliers").alias("iqr_outliers"),
                     F.col(f"{c}__z_outliers").alias("z_outliers"),
                     F.lit(f.stats[c]["min"]).cast("double").alias("min"),
                     F.lit(f.stats[c]["max"]).cast("double").alias("max")) for c in cols]
    long = agg.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    if only_flagged:
        long = long.filter((F.col("iqr_outliers") > 0) | (F.col("z_outliers") > 0))
    return long


def flag_outliers(df: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, k: float = 1.5,
                  out: str = "is_outlier", fences: Fences | None = None) -> DataFrame:
    """E5: 1 when any feature lies strictly outside its fence."""
    f = fences or fit_fences(df, cols, k)
    any_out = F.lit(False)
    for c in cols:
        any_out = any_out | F.coalesce(f.outside(c), F.lit(False))
    return df.withColumn(out, any_out.cast("int"))


def outlier_rate(df: DataFrame, col: str = "is_outlier") -> DataFrame:
    """Flagged rows and their share of all rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(col).cast("long").alias("outlier_rows"),
                  (F.sum(col) * 100.0 / F.count(F.lit(1))).alias("outlier_pct"))
