"""Time-series queries I1-I8 over the labeled stand-in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposcope.operators import timeseries as ts
from exposcope.plans.catalog import query
from exposcope.plans.sqlbase import with_ctes
from exposcope.sources.standin import exposure_labeled

ALPHA = 2.0 / 15.0

_DAILY = """daily AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, avg(risk_score) AS mean_risk,
  max(risk_score) AS max_risk, count(risk_score) AS event_count FROM labeled GROUP BY 1)"""
_DAILY_SRC = """daily AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS date, source_type, avg(risk_score) AS mean_risk,
  max(risk_score) AS max_risk, count(risk_score) AS event_count FROM labeled GROUP BY 1, 2)"""
_W = """WINDOW w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
_STATS = """(SELECT *, avg(mean_risk) OVER w30 AS r30,
   CASE WHEN count(mean_risk) OVER w30 >= 7 THEN stddev_samp(mean_risk) OVER w30 END AS s30,
   avg(mean_risk) OVER w7 AS r7 FROM daily """ + _W + ")"


def _daily(spark, sf_dir, by=()):
    return ts.daily_risk(exposure_labeled(spark, sf_dir), by=by)


@query("i1_daily_risk", with_ctes("SELECT * FROM daily", extra=_DAILY))
def i1_daily_risk(spark, sf_dir):
    return _daily(spark, sf_dir)


@query("i1_daily_risk_by_source", with_ctes("SELECT * FROM daily", extra=_DAILY_SRC))
def i1_daily_risk_by_source(spark, sf_dir):
    return _daily(spark, sf_dir, by=["source_type"])


@query("i2_rolling_mean", with_ctes(
    "SELECT date, round(avg(mean_risk) OVER w7, 6) AS rolling_7d, "
    "round(avg(mean_risk) OVER w30, 6) AS rolling_30d FROM daily " + _W, extra=_DAILY))
def i2_rolling_mean(spark, sf_dir):
    d = ts.rolling_mean(ts.rolling_mean(_daily(spark, sf_dir), 7), 30)
    return d.select("date", F.round("rolling_7d", 6).alias("rolling_7d"),
                    F.round("rolling_30d", 6).alias("rolling_30d"))


@query("i3_rolling_std", with_ctes(
    "SELECT date, round(s30, 6) AS rolling_std FROM " + _STATS, extra=_DAILY))
def i3_rolling_std(spark, sf_dir):
    d = ts.rolling_std(_daily(spark, sf_dir), 30, 7)
    return d.select("date", F.round("rolling_std", 6).alias("rolling_std"))


_EWMA_CTE = _DAILY + f""",
d AS MATERIALIZED (SELECT date, mean_risk, row_number() OVER (ORDER BY date) AS rn FROM daily),
e(rn, date, ewma) AS (
  SELECT rn, date, mean_risk FROM d WHERE rn = 1
  UNION ALL
  SELECT d.rn, d.date, e.ewma * {1.0 - ALPHA!r} + d.mean_risk * {ALPHA!r} FROM e JOIN d ON d.rn = e.rn + 1)"""


@query("i4_ewma", with_ctes("SELECT date, round(ewma, 6) AS ewma_14d FROM e",
                            extra=_EWMA_CTE).replace("WITH ", "WITH RECURSIVE ", 1))
def i4_ewma(spark, sf_dir):
    d = ts.ewma(_daily(spark, sf_dir), 14)
    return d.select("date", F.round("ewma_14d", 6).alias("ewma_14d"))


@query("i5_spikes", with_ctes(
    "SELECT date, mean_risk, round(r30 + 2e0*s30, 6) AS spike_threshold, "
    "CAST(coalesce(mean_risk > r30 + 2e0*s30, false) AS INTEGER) AS is_spike FROM " + _STATS,
    extra=_DAILY))
def i5_spikes(spark, sf_dir):
    d = ts.detect_spikes(_daily(spark, sf_dir), 2.0)
    return d.select("date", "mean_risk", F.round("spike_threshold", 6).alias("spike_threshold"),
                    "is_spike")


@query("i5_spikes_by_source", with_ctes(
    """SELECT date, source_type, mean_risk,
  CAST(coalesce(mean_risk > avg(mean_risk) OVER w + 2e0 *
    CASE WHEN count(mean_risk) OVER w >= 7 THEN stddev_samp(mean_risk) OVER w END, false) AS INTEGER) AS is_spike
FROM daily WINDOW w AS (PARTITION BY source_type ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    extra=_DAILY_SRC))
def i5_spikes_by_source(spark, sf_dir):
    d = ts.detect_spikes(_daily(spark, sf_dir, by=["source_type"]), 2.0, by=["source_type"])
    return d.select("date", "source_type", "mean_risk", "is_spike")


@query("i6_spikes_offset", with_ctes(
    "SELECT date, CAST(mean_risk > r30 + 1.5e0 AS INTEGER) AS is_spike_offset FROM " + _STATS,
    extra=_DAILY))
def i6_spikes_offset(spark, sf_dir):
    d = ts.detect_spikes_offset(_daily(spark, sf_dir), 1.5)
    return d.select("date", "is_spike_offset")


@query("i7_spike_summary", with_ctes(
    """SELECT count(*) AS days, CAST(sum(is_spike) AS BIGINT) AS spikes,
  round(sum(is_spike) * 100e0 / count(*), 6) AS spike_pct,
  round(avg(mean_risk), 6) AS mean_daily_risk, round(max(mean_risk), 6) AS max_daily_risk
FROM (SELECT mean_risk, CAST(coalesce(mean_risk > r30 + 2e0*s30, false) AS INTEGER) AS is_spike
      FROM """ + _STATS + ")", extra=_DAILY))
def i7_spike_summary(spark, sf_dir):
    s = ts.spike_summary(ts.detect_spikes(_daily(spark, sf_dir)))
    return s.select("days", "spikes", *[F.round(c, 6).alias(c) for c in
                                         ["spike_pct", "mean_daily_risk", "max_daily_risk"]])


@query("i8_stress_overlay", with_ctes(
    """SELECT date, round(mr, 6) AS mean_risk,
  round(CASE WHEN in_tail = 1 THEN avg(mr) OVER (PARTITION BY in_tail ORDER BY date
        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) ELSE r7 END, 6) AS rolling_7d,
  CASE WHEN in_tail = 1 THEN 1 ELSE is_spike END AS is_spike, in_tail
FROM (SELECT date, r7, CAST(coalesce(mean_risk > r30 + 2e0*s30, false) AS INTEGER) AS is_spike,
        CAST(row_number() OVER (ORDER BY date DESC) <= 15 AS INTEGER) AS in_tail,
        CASE WHEN row_number() OVER (ORDER BY date DESC) <= 15 THEN mean_risk * 1.8e0 + 1.5e0
             ELSE mean_risk END AS mr
      FROM """ + _STATS + ")", extra=_DAILY))
def i8_stress_overlay(spark, sf_dir):
    d = ts.detect_spikes(ts.rolling_mean(_daily(spark, sf_dir), 7))
    s = ts.stress_overlay(d)
    return s.select("date", F.round("mean_risk", 6).alias("mean_risk"),
                    F.round("rolling_7d", 6).alias("rolling_7d"), "is_spike", "in_tail")


@query("b3_spikes_only", with_ctes(
    "SELECT date, mean_risk FROM " + _STATS + " WHERE mean_risk > r30 + 2e0*s30", extra=_DAILY))
def b3_spikes_only(spark, sf_dir):
    return ts.spikes_only(ts.detect_spikes(_daily(spark, sf_dir))).select("date", "mean_risk")


@query("i9_risk_series", with_ctes(
    """SELECT s.date, s.mean_risk, s.max_risk, s.event_count, round(s.r7, 6) AS rolling_7d,
  round(s.r30, 6) AS rolling_30d, round(e.ewma, 6) AS ewma_14d,
  round(s.r30 + 2e0*s.s30, 6) AS spike_threshold,
  CAST(coalesce(s.mean_risk > s.r30 + 2e0*s.s30, false) AS INTEGER) AS is_spike
FROM """ + _STATS + " s JOIN e ON s.date = e.date", extra=_EWMA_CTE).replace("WITH ", "WITH RECURSIVE ", 1))
def i9_risk_series(spark, sf_dir):
    d = ts.risk_series(exposure_labeled(spark, sf_dir))
    return d.select("date", "mean_risk", "max_risk", "event_count",
                    *[F.round(c, 6).alias(c) for c in
                      ["rolling_7d", "rolling_30d", "ewma_14d", "spike_threshold"]], "is_spike")


_EWMA_SRC_CTE = _DAILY_SRC + f""",
d AS MATERIALIZED (SELECT date, source_type, mean_risk,
  row_number() OVER (PARTITION BY source_type ORDER BY date) AS rn FROM daily),
e(source_type, rn, date, ewma) AS (
  SELECT source_type, rn, date, mean_risk FROM d WHERE rn = 1
  UNION ALL
  SELECT d.source_type, d.rn, d.date, e.ewma * {1.0 - ALPHA!r} + d.mean_risk * {ALPHA!r}
  FROM e JOIN d ON d.source_type = e.source_type AND d.rn = e.rn + 1)"""


@query("i4_ewma_by_source", with_ctes(
    "SELECT date, source_type, round(ewma, 6) AS ewma_14d FROM e",
    extra=_EWMA_SRC_CTE).replace("WITH ", "WITH RECURSIVE ", 1))
def i4_ewma_by_source(spark, sf_dir):
    """EWMA per key: the window is partitioned by source, each series folds its own frame."""
    d = ts.ewma(_daily(spark, sf_dir, by=["source_type"]), 14, by=["source_type"])
    return d.select("date", "source_type", F.round("ewma_14d", 6).alias("ewma_14d"))
