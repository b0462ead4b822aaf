"""Daily risk time series.

The event table is reduced by a partial (map-side) aggregation to one row per
day and group key; all window work runs on that roll-up only.  Its size is
bounded by calendar days x group keys, never by event count, so an ordered
window over one series stays small even at 100 TB of events, and a hot key
(a third of all events) costs no more than any other key after the roll-up.
Rolling windows count rows, not calendar days (days without events are
absent, as in the published pipeline).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposcope.operators.joins import attach


def _w(by: Sequence[str], order: str = "date"):
    w = Window.orderBy(order)
    return Window.partitionBy(*by).orderBy(order) if by else w


def daily_risk(df: DataFrame, ts_col: str = "ts", value_col: str = "risk_score",
               by: Sequence[str] = ()) -> DataFrame:
    """Per day (and key): mean, max and count of the risk level.

    ``date`` is the day as a midnight timestamp (no time zone).
    """
    day = F.to_date(F.col(ts_col)).cast("timestamp_ntz")
    return (df.groupBy(day.alias("date"), *by)
            .agg(F.avg(value_col).alias("mean_risk"),
                 F.max(value_col).alias("max_risk"),
                 F.count(value_col).alias("event_count")))


def rolling_mean(daily: DataFrame, n: int, col: str = "mean_risk", out: str | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean over the last n rows (the current one included), min_periods 1."""
    w = _w(by).rowsBetween(-(n - 1), 0)
    return daily.withColumn(out or f"rolling_{n}d", F.avg(col).over(w))


def rolling_std(daily: DataFrame, n: int = 30, min_periods: int = 7, col: str = "mean_risk",
                out: str = "rolling_std", by: Sequence[str] = ()) -> DataFrame:
    """Sample std over the last n rows; null until ``min_periods`` rows."""
    w = _w(by).rowsBetween(-(n - 1), 0)
    return daily.withColumn(out, F.when(F.count(col).over(w) >= min_periods,
                                        F.stddev_samp(col).over(w)))


def ewma(daily: DataFrame, span: float = 14, col: str = "mean_risk", out: str | None = None,
         by: Sequence[str] = (), order: str = "date", block: int = 128) -> DataFrame:
    """I4: recursive EWMA (adjust=False, y0 = x0), span 14 by default; rows without
    a value repeat the average so far.

    y_t = (1-a) y_{t-1} + a x_t is linear in the value that enters a block of
    rows: each block is folded from zero, the block ends are carried over the
    blocks (rows / ``block`` of them per series), and a row is its block's fold
    plus the decayed carry.  Exact, and linear in the rows.
    """
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    w, keys = _w(by, order), [*by, "__block"]
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumns({"__row": F.row_number().over(w),
                           "__x0": F.first(F.col(col).cast("double"), ignorenulls=True).over(all_rows)})
    d = d.withColumn("__block", F.floor((F.col("__row") - 1) / block))
    d = d.withColumn("__xs", F.collect_list(F.col(col).cast("double")).over(inside))
    d = d.withColumns({"__fold": F.aggregate("__xs", F.lit(0.0), lambda y, x: y * keep + x * alpha),
                       "__decay": F.pow(F.lit(keep), F.size("__xs")),
                       "__seen": F.count(col).over(w.rowsBetween(Window.unboundedPreceding, 0))}).drop("__xs")
    ends = d.groupBy(*keys, "__x0").agg(F.max_by(F.struct("__fold", "__decay"), "__row").alias("__end"))
    before = _w(by, "__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, F.aggregate(F.collect_list("__end").over(before), F.col("__x0"),
                                           lambda y, e: y * e["__decay"] + e["__fold"]).alias("__carry"))
    y = F.when(F.col("__seen") > 0, F.col("__fold") + F.col("__decay") * F.col("__carry"))
    return attach(d, carry, keys).withColumn(out or f"ewma_{int(span)}d", y) \
        .drop("__row", "__x0", "__block", "__fold", "__decay", "__seen", "__carry")


def detect_spikes(daily: DataFrame, k: float = 2.0, n: int = 30, min_periods: int = 7,
                  col: str = "mean_risk", by: Sequence[str] = ()) -> DataFrame:
    """threshold = rolling-n mean + k * rolling-n sample std; flag above it.

    A missing threshold (fewer than ``min_periods`` rows) never flags.
    """
    w = _w(by).rowsBetween(-(n - 1), 0)
    std = F.when(F.count(col).over(w) >= min_periods, F.stddev_samp(col).over(w))
    thr = F.avg(col).over(w) + k * std
    out = daily.withColumn("spike_threshold", thr)
    return out.withColumn("is_spike", F.coalesce(F.col(col) > F.col("spike_threshold"),
                                                 F.lit(False)).cast("int"))


def detect_spikes_offset(daily: DataFrame, offset: float = 1.5, n: int = 30,
                         col: str = "mean_risk", by: Sequence[str] = ()) -> DataFrame:
    """Spike when the value exceeds the rolling-n mean by ``offset``."""
    w = _w(by).rowsBetween(-(n - 1), 0)
    return daily.withColumn("is_spike_offset",
                            (F.col(col) > F.avg(col).over(w) + offset).cast("int"))


def risk_series(df: DataFrame, ts_col: str = "ts", value_col: str = "risk_score",
                by: Sequence[str] = (), span: float = 14, k: float = 2.0) -> DataFrame:
    """I1 + I2 (7, 30) + I4 + I5 in one pass over the daily roll-up."""
    daily = daily_risk(df, ts_col, value_col, by)
    daily = rolling_mean(daily, 7, by=by)
    daily = rolling_mean(daily, 30, by=by)
    daily = ewma(daily, span, by=by)
    return detect_spikes(daily, k, by=by)


def spike_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Days, spike days, spike %, mean and max of the daily mean."""
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("is_spike").cast("long").alias("spikes"),
        (F.sum("is_spike") * 100.0 / F.count(F.lit(1))).alias("spike_pct"),
        F.avg("mean_risk").alias("mean_daily_risk"),
        F.max("mean_risk").alias("max_daily_risk"),
    )


def spikes_only(daily: DataFrame) -> DataFrame:
    """Rows flagged as spikes."""
    return daily.filter(F.col("is_spike") == 1)


def stress_overlay(daily: DataFrame, last: int = 15, mul: float = 1.8, add: float = 1.5,
                   col: str = "mean_risk", by: Sequence[str] = ()) -> DataFrame:
    """I8: what-if surge on the last ``last`` rows of each series.

    The tail gets ``col * mul + add``, a 7-row mean recomputed inside the tail
    only, and a spike flag; other rows keep their values.
    """
    tail_rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc())
                                    if by else Window.orderBy(F.col("date").desc()))
    d = daily.withColumn("in_tail", (tail_rank <= last).cast("int"))
    d = d.withColumn(col, F.when(F.col("in_tail") == 1, F.col(col) * mul + add)
                     .otherwise(F.col(col)))
    seg = Window.partitionBy(*by, "in_tail").orderBy("date").rowsBetween(-6, 0)
    d = d.withColumn("rolling_7d", F.when(F.col("in_tail") == 1, F.avg(col).over(seg))
                     .otherwise(F.col("rolling_7d")))
    return d.withColumn("is_spike", F.when(F.col("in_tail") == 1, F.lit(1))
                        .otherwise(F.col("is_spike")))
