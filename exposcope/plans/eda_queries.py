"""EDA aggregates (H1, H2, H4-H12) and sort / top-k / union."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from exposcope.operators import eda
from exposcope.operators.prepare import clean_events
from exposcope.operators.risk import heuristic_anomaly
from exposcope.plans.catalog import query
from exposcope.plans.prep_queries import CAT_GAPS, NUM_GAPS, PREP_CTES, _SEV
from exposcope.plans.sqlbase import with_ctes
from exposcope.schema import CORR_FEATURES, SEED_COLUMNS
from exposcope.session import cut_lineage
from exposcope.sources.standin import exposure_labeled, exposure_raw

_EDA = ("eda AS (SELECT dd.*, least(greatest(cvss_base_score/10e0*0.5e0 + CAST(" + _SEV
        + " AS INTEGER)/3e0*0.3e0 + 0.1e0, 0e0), 1e0) AS anomaly_score FROM dd)")
EDA_CTES = PREP_CTES + ",\n" + _EDA
RISK_NAME = ("CASE risk_score WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' "
             "WHEN 3 THEN 'Critical' WHEN 4 THEN 'Emergency' END")


def _sql(body, extra=EDA_CTES):
    return with_ctes(body, raw=True, extra=extra)


def eda_base(spark, sf_dir, cols=None, again=True):
    """Cleaned events with an anomaly score (rule form), the input of every chart.
    ``cols``: the columns that the chart reads; ``again``: whether more than one
    pass reads them (then they, and only they, are written once)."""
    d = heuristic_anomaly(clean_events(exposure_raw(spark, sf_dir), NUM_GAPS, CAT_GAPS, materialize=False))
    d = d.select(*cols) if cols else d
    return cut_lineage(d) if again else d


@query("h1_risk_distribution", _sql(
    "SELECT l.risk_score, " + RISK_NAME.replace("risk_score", "l.risk_score") + " AS risk_label, "
    "coalesce(c.n, 0) AS count, coalesce(c.n, 0) * 100e0 / (SELECT count(*) FROM eda) AS pct "
    "FROM (SELECT CAST(range AS INTEGER) AS risk_score FROM range(5)) l LEFT JOIN "
    "(SELECT risk_score, count(*) AS n FROM eda GROUP BY 1) c ON l.risk_score = c.risk_score"))
def h1_risk_distribution(spark, sf_dir):
    return eda.risk_distribution(eda_base(spark, sf_dir, ["risk_score"], again=False))


@query("h2_source_distribution", _sql(
    "SELECT source_type, count(*) AS count, count(*) * 100e0 / sum(count(*)) OVER () AS pct "
    "FROM eda GROUP BY 1"))
def h2_source_distribution(spark, sf_dir):
    return eda.value_distribution(eda_base(spark, sf_dir, ["source_type"], again=False), "source_type")


@query("h4_histogram_by_risk", _sql(
    """SELECT risk_score, bin, round(lo + bin * (hi - lo) / 40e0, 6) AS bin_lo,
  round(lo + (bin + 1) * (hi - lo) / 40e0, 6) AS bin_hi, count(*) AS count FROM (
  SELECT e.risk_score, s.lo, s.hi, CAST(CASE WHEN (s.hi - s.lo) / 40e0 = 0 THEN 0 ELSE
    least(floor((e.cvss_base_score - s.lo) / ((s.hi - s.lo) / 40e0)), 39) END AS INTEGER) AS bin
  FROM eda e JOIN (SELECT risk_score, min(cvss_base_score) AS lo, max(cvss_base_score) AS hi
                   FROM eda GROUP BY 1) s ON e.risk_score = s.risk_score)
GROUP BY risk_score, bin, lo, hi"""))
def h4_histogram_by_risk(spark, sf_dir):
    return _histogram(eda_base(spark, sf_dir, ["risk_score", "cvss_base_score"]), "cvss_base_score")


def _histogram(base, feat):
    h = eda.histogram_by(base, feat, ["risk_score"], 40)
    return h.select("risk_score", "bin", F.round("bin_lo", 6).alias("bin_lo"),
                    F.round("bin_hi", 6).alias("bin_hi"), "count")


_PAIRS = [(a, b) for i, a in enumerate(CORR_FEATURES) for j, b in enumerate(CORR_FEATURES) if j <= i]


@query("h5_correlation", _sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), "
        f"CAST({b} AS DOUBLE)), 6) AS r FROM eda" for a, b in _PAIRS) + ")"))
def h5_correlation(spark, sf_dir):
    c = eda.correlation_matrix(eda_base(spark, sf_dir, CORR_FEATURES), CORR_FEATURES)
    return c.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@query("h6_box_stats", _sql(
    """SELECT q.risk_score, q.n, q.q1, q.median, q.q3,
  min(CASE WHEN v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1) THEN v END) AS whisker_hi,
  CAST(count_if(NOT (v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1))) AS BIGINT) AS outliers
FROM (SELECT risk_score, CAST(exposure_velocity AS DOUBLE) AS v FROM eda) e
JOIN (SELECT risk_score, count(*) AS n, quantile_cont(CAST(exposure_velocity AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(exposure_velocity AS DOUBLE), 0.5) AS median,
        quantile_cont(CAST(exposure_velocity AS DOUBLE), 0.75) AS q3 FROM eda GROUP BY 1) q
  ON e.risk_score = q.risk_score
GROUP BY q.risk_score, q.n, q.q1, q.median, q.q3"""))
def h6_box_stats(spark, sf_dir):
    return eda.box_stats(eda_base(spark, sf_dir, ["risk_score", "exposure_velocity"], again=False), "exposure_velocity", ["risk_score"])


_HIST_SQL = """SELECT risk_score, bin, round(lo + bin * (hi - lo) / 40e0, 6) AS bin_lo,
  round(lo + (bin + 1) * (hi - lo) / 40e0, 6) AS bin_hi, count(*) AS count FROM (
  SELECT e.risk_score, s.lo, s.hi, CAST(CASE WHEN (s.hi - s.lo) / 40e0 = 0 THEN 0 ELSE
    least(floor((CAST(e.{f} AS DOUBLE) - s.lo) / ((s.hi - s.lo) / 40e0)), 39) END AS INTEGER) AS bin
  FROM eda e JOIN (SELECT risk_score, CAST(min({f}) AS DOUBLE) AS lo, CAST(max({f}) AS DOUBLE) AS hi
                   FROM eda GROUP BY 1) s ON e.risk_score = s.risk_score)
GROUP BY risk_score, bin, lo, hi"""
_BOX_SQL = """SELECT q.risk_score, q.n, q.q1, q.median, q.q3,
  min(CASE WHEN v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1) THEN v END) AS whisker_hi,
  CAST(count_if(NOT (v >= q.q1 - 1.5e0*(q.q3-q.q1) AND v <= q.q3 + 1.5e0*(q.q3-q.q1))) AS BIGINT) AS outliers
FROM (SELECT risk_score, CAST({f} AS DOUBLE) AS v FROM eda) e
JOIN (SELECT risk_score, count(*) AS n, quantile_cont(CAST({f} AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST({f} AS DOUBLE), 0.5) AS median,
        quantile_cont(CAST({f} AS DOUBLE), 0.75) AS q3 FROM eda GROUP BY 1) q
  ON e.risk_score = q.risk_score
GROUP BY q.risk_score, q.n, q.q1, q.median, q.q3"""


def _register_feature_charts():
    for f in ("anomaly_score", "exposure_velocity", "domain_reputation_score"):
        query(f"h4_histogram_{f}", _sql(_HIST_SQL.format(f=f)))(
            lambda spark, sf_dir, f=f: _histogram(eda_base(spark, sf_dir, ["risk_score", f]), f))
    for f in ("cvss_base_score", "anomaly_score", "domain_reputation_score"):
        query(f"h6_box_{f}", _sql(_BOX_SQL.format(f=f)))(
            lambda spark, sf_dir, f=f: eda.box_stats(eda_base(spark, sf_dir, ["risk_score", f], again=False), f))


_register_feature_charts()


_NORM = 1.0 / math.sqrt(2 * math.pi)


@query("h7_density_by_risk", _sql(
    f"""SELECT risk_score, i, round(g0 + i * step, 6) AS x,
  round(sum(c * exp(-0.5e0 * pow((g0 + i * step - v) / bw, 2))) * {_NORM!r} / (n * bw), 6) AS density
FROM (SELECT vals.risk_score, vals.v, vals.c, st.n, st.bw, st.lo - 2e0 * st.bw AS g0,
        (st.hi - st.lo + 2e0 * 2e0 * st.bw) / 99e0 AS step
      FROM (SELECT risk_score, CAST(cvss_base_score AS DOUBLE) AS v, count(*) AS c FROM eda GROUP BY 1, 2) vals
      JOIN (SELECT risk_score, count(*) AS n, min(CAST(cvss_base_score AS DOUBLE)) AS lo,
              max(CAST(cvss_base_score AS DOUBLE)) AS hi,
              stddev_samp(CAST(cvss_base_score AS DOUBLE)) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bw
            FROM eda GROUP BY 1) st ON vals.risk_score = st.risk_score
      WHERE st.bw > 0) d, range(100) t(i)
GROUP BY risk_score, i, g0, step, n, bw"""))
def h7_density_by_risk(spark, sf_dir):
    d = eda.density_by(eda_base(spark, sf_dir, ["risk_score", "cvss_base_score"], again=False), "cvss_base_score", ["risk_score"])
    return d.select("risk_score", F.col("i").cast("bigint").alias("i"),
                    F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


_VIOLIN = """SELECT i, t.risk_score, round(g0 + i * step, 6) AS x, round(sum(CASE WHEN abs(z) <= 8e0 THEN w * exp(-0.5e0 * z * z) ELSE 0e0 END) * {norm!r} / (n * bw), 6) AS density,
  round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3
FROM (SELECT *, (g0 + i * step - b) / bw AS z FROM (
  SELECT risk_score, n, bw, lo - 2e0 * bw AS g0, (hi - lo + 2e0 * 2e0 * bw) / 99e0 AS step, lo + j * d AS b, sum(w) AS w FROM (
    SELECT risk_score, n, bw, lo, hi, d, unnest([floor(p), floor(p) + 1]) AS j, unnest([floor(p) + 1 - p, p - floor(p)]) AS w FROM (
      SELECT e.risk_score, n, bw, lo, hi, d, least((CAST({col} AS DOUBLE) - lo) / d, 1023e0) AS p FROM eda e JOIN (
        SELECT *, (hi - lo) / 1023e0 AS d FROM (SELECT risk_score, count(*) AS n, min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi,
          stddev_samp(CAST({col} AS DOUBLE)) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bw FROM eda GROUP BY 1)) st
      ON e.risk_score = st.risk_score WHERE bw > 0))
  WHERE w > 0 GROUP BY risk_score, n, bw, lo, hi, d, j), range(100) r(i)) t
JOIN (SELECT risk_score, quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({col} AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM eda GROUP BY 1) q ON q.risk_score = t.risk_score
GROUP BY t.risk_score, i, g0, step, n, bw"""


def _violin(col):
    def run(spark, sf_dir):
        d = eda.violin(eda_base(spark, sf_dir, ["risk_score", col]), col, ["risk_score"])
        return d.select("risk_score", F.col("i").cast("bigint").alias("i"), *[F.round(c, 6).alias(c) for c in ("x", "density", "q1", "median", "q3")])
    return run


for _col in ("cvss_base_score", "exposure_velocity", "anomaly_score"):
    query(f"h7_violin_{_col}", _sql(_VIOLIN.format(col=_col, norm=_NORM)))(_violin(_col))


@query("h8_density_2d", _sql(
    """SELECT bin_x, bin_y, count(*) AS count, avg(risk_score) AS mean_risk_score FROM (
  SELECT risk_score,
    CAST(CASE WHEN s.x1 = s.x0 THEN 0 ELSE least(floor((cvss_base_score - s.x0) / ((s.x1 - s.x0) / 20e0)), 19) END AS INTEGER) AS bin_x,
    CAST(CASE WHEN s.y1 = s.y0 THEN 0 ELSE least(floor((anomaly_score - s.y0) / ((s.y1 - s.y0) / 20e0)), 19) END AS INTEGER) AS bin_y
  FROM eda, (SELECT min(cvss_base_score) AS x0, max(cvss_base_score) AS x1,
                    min(anomaly_score) AS y0, max(anomaly_score) AS y1 FROM eda) s)
GROUP BY 1, 2"""))
def h8_density_2d(spark, sf_dir):
    return eda.density_2d(eda_base(spark, sf_dir, ["cvss_base_score", "anomaly_score", "risk_score"]), "cvss_base_score", "anomaly_score")


_CELLS_SQL = """SELECT bin_x, bin_y, count(*) AS count, avg(risk_score) AS mean_risk_score FROM (
  SELECT risk_score,
    CAST(CASE WHEN s.x1 = s.x0 THEN 0 ELSE least(floor((exposure_velocity - s.x0) / ((s.x1 - s.x0) / 20e0)), 19) END AS INTEGER) AS bin_x,
    CAST(CASE WHEN s.y1 = s.y0 THEN 0 ELSE least(floor((anomaly_score - s.y0) / ((s.y1 - s.y0) / 20e0)), 19) END AS INTEGER) AS bin_y
  FROM eda, (SELECT min(exposure_velocity) AS x0, max(exposure_velocity) AS x1,
                    min(anomaly_score) AS y0, max(anomaly_score) AS y1 FROM eda) s)
GROUP BY 1, 2"""


@query("h8_density_velocity_anomaly", _sql(_CELLS_SQL))
def h8_density_velocity_anomaly(spark, sf_dir):
    return eda.density_2d(eda_base(spark, sf_dir, ["exposure_velocity", "anomaly_score", "risk_score"]),
                          "exposure_velocity", "anomaly_score")


_PAIR_COLS = ["cvss_base_score", "domain_reputation_score", "exposure_frequency", "anomaly_score"]


@query("h9_pair_sample", _sql(
    "SELECT event_id, " + ", ".join(_PAIR_COLS) + ", risk_score FROM eda "
    "ORDER BY md5(concat('42-', event_id)), event_id LIMIT 3000"))
def h9_pair_sample(spark, sf_dir):
    return eda.pair_sample(eda_base(spark, sf_dir, ["event_id", *_PAIR_COLS, "risk_score"], again=False), _PAIR_COLS, 3000, 42)


@query("h10_mean_risk_by_source", _sql(
    "SELECT *, row_number() OVER (ORDER BY mean_risk, source_type) AS position FROM "
    "(SELECT source_type, avg(risk_score) AS mean_risk FROM eda GROUP BY 1)"))
def h10_mean_risk_by_source(spark, sf_dir):
    base = eda_base(spark, sf_dir, ["source_type", "risk_score"], again=False)
    return eda.with_position(eda.mean_risk_by(base, "source_type"))


@query("h11_sample_n", _sql(
    "SELECT event_id, ts, risk_score FROM eda ORDER BY md5(concat('7-', event_id)), event_id "
    "LIMIT 500"))
def h11_sample_n(spark, sf_dir):
    return eda.sample_n(eda_base(spark, sf_dir, ["event_id", "ts", "risk_score"], again=False), 500, seed=7)


@query("h12_crosstab_source_risk", _sql(
    "SELECT source_type, " + ", ".join(
        f"count_if(risk_score = {i}) * 100e0 / count(*) AS pct_{nm}"
        for i, nm in enumerate(["Low", "Medium", "High", "Critical", "Emergency"]))
    + " FROM eda GROUP BY 1"))
def h12_crosstab_source_risk(spark, sf_dir):
    return eda.crosstab_pct(eda_base(spark, sf_dir, ["source_type", "risk_score"], again=False), "source_type")


@query("j1_sort_events", with_ctes(
    "SELECT event_id, ts, risk_score, row_number() OVER (ORDER BY ts, event_id) AS position FROM labeled"))
def j1_sort_events(spark, sf_dir):
    return eda.with_position(eda.sort_events(
        exposure_labeled(spark, sf_dir).select("event_id", "ts", "risk_score")))


@query("j2_top_k_velocity", with_ctes(
    "SELECT event_id, exposure_velocity FROM labeled ORDER BY exposure_velocity DESC, event_id "
    "LIMIT 20"))
def j2_top_k_velocity(spark, sf_dir):
    t = eda.top_k(exposure_labeled(spark, sf_dir), "exposure_velocity", 20, key="event_id")
    return t.select("event_id", "exposure_velocity")


@query("j3_union_events", with_ctes(
    "SELECT event_id, ts, source_type, cvss_base_score, risk_score FROM labeled UNION ALL "
    "SELECT NULL AS event_id, NULL AS ts, source_type, cvss_base_score, NULL AS risk_score "
    "FROM raw", raw=True))
def j3_union_events(spark, sf_dir):
    a = exposure_labeled(spark, sf_dir).select("event_id", "ts", "source_type", "cvss_base_score",
                                               "risk_score")
    u = eda.union_events(a, exposure_raw(spark, sf_dir).select(*SEED_COLUMNS))
    return u.select("event_id", "ts", "source_type", "cvss_base_score", "risk_score")
