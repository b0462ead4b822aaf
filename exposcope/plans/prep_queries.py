"""Profiling, cleaning, encoding, scaling and outlier queries (C*, D*, E*, H3, H13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposcope.functions.columns import lookup, rounded
from exposcope.operators import clean, encode, outliers, profile
from exposcope.operators.prepare import clean_events, preprocess
from exposcope.plans.catalog import query
from exposcope.plans.sqlbase import with_ctes
from exposcope.schema import (
    ARTIFACT_TYPES, MODEL_FEATURES, OUTLIER_FEATURES, SCALE_FEATURES, SOURCE_TYPES,
)
from exposcope.sources.standin import GAP_COLUMNS, exposure_raw

NUM_GAPS = [c for c in GAP_COLUMNS if c not in ("exploit_maturity", "leak_severity")]
CAT_GAPS = ["exploit_maturity", "leak_severity"]
RAW_COLS = ["event_id", "ts", "source_type", "artifact_type", "domain", "subdomain_count",
            "subdomain_age_days", "domain_reputation_score", "cvss_base_score",
            "exploit_availability", "exploit_maturity", "cve_age_days", "exposure_frequency",
            "leak_severity", "has_credentials", "paste_site_mentions", "ct_log_anomaly",
            "ssl_days_remaining", "open_ports_count", "service_version_outdated",
            "dns_record_type_count", "is_wildcard_dns", "github_leak_count",
            "exposure_velocity", "risk_score"]

# ---- oracle building blocks ------------------------------------------------
_MED = "med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in NUM_GAPS) + " FROM raw)"
_MODES = ",\n".join(
    f"mo_{c} AS (SELECT {c} AS v FROM raw WHERE {c} IS NOT NULL GROUP BY 1 "
    f"ORDER BY count(*) DESC, 1 LIMIT 1)" for c in CAT_GAPS)


def _imp_col(c):
    if c in NUM_GAPS:
        return f"coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}"
    if c in CAT_GAPS:
        return f"coalesce({c}, (SELECT v FROM mo_{c})) AS {c}"
    return c


_IMP = "imp AS (SELECT " + ", ".join(_imp_col(c) for c in RAW_COLS) + " FROM raw)"
_DEDUP = "dd AS (SELECT DISTINCT * FROM imp)"
_SEV = ("CASE leak_severity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 "
        "WHEN 'Critical' THEN 3 END")
_MAT = ("CASE exploit_maturity WHEN 'None' THEN 0 WHEN 'POC' THEN 1 WHEN 'Functional' THEN 2 "
        "WHEN 'Weaponized' THEN 3 END")
_ENC = ("enc AS (SELECT dd.*, CAST(" + _SEV + " AS INTEGER) AS leak_severity_encoded, CAST("
        + _MAT + " AS INTEGER) AS exploit_maturity_encoded, "
        + ", ".join(f"CAST(coalesce(source_type = '{v}', false) AS INTEGER) AS source_{v}"
                    for v in SOURCE_TYPES) + ", "
        + ", ".join(f"CAST(coalesce(artifact_type = '{v}', false) AS INTEGER) AS artifact_{v}"
                    for v in ARTIFACT_TYPES)
        + ", CAST(dense_rank() OVER (ORDER BY domain) - 1 AS INTEGER) AS domain_encoded FROM dd)")
_Q = ("qs AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) "
    f"AS q3_{c}, avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}"
    for c in OUTLIER_FEATURES) + " FROM enc)")


def _outside(c):
    return (f"({c} < (SELECT q1_{c} - 1.5e0*(q3_{c}-q1_{c}) FROM qs) OR "
            f"{c} > (SELECT q3_{c} + 1.5e0*(q3_{c}-q1_{c}) FROM qs))")


_FLAG = ("flagged AS (SELECT enc.*, CAST(" + " OR ".join(_outside(c) for c in OUTLIER_FEATURES)
         + " AS INTEGER) AS is_outlier FROM enc)")
PREP_CTES = ",\n".join([_MED, _MODES, _IMP, _DEDUP, _ENC])


def _raw(spark, sf_dir):
    return exposure_raw(spark, sf_dir)


def _prep(spark, sf_dir, flag=True):
    return preprocess(_raw(spark, sf_dir), NUM_GAPS, CAT_GAPS, flag=flag)


# ---- C: profiling and cleaning ----------------------------------------------
@query("c1_null_profile", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, "
        f"(count(*) - count({c})) * 100e0 / count(*) AS null_pct FROM raw" for c in RAW_COLS)
    + ") WHERE null_count > 0", raw=True))
def c1_null_profile(spark, sf_dir):
    return profile.null_profile(_raw(spark, sf_dir).drop("_o"))


@query("c2_impute_median", with_ctes(
    "SELECT event_id, " + ", ".join(NUM_GAPS) + " FROM imp", raw=True, extra=PREP_CTES))
def c2_impute_median(spark, sf_dir):
    return clean.impute_median(_raw(spark, sf_dir), NUM_GAPS).select("event_id", *NUM_GAPS)


@query("c3_impute_mode", with_ctes(
    "SELECT event_id, " + ", ".join(CAT_GAPS) + " FROM imp", raw=True, extra=PREP_CTES))
def c3_impute_mode(spark, sf_dir):
    return clean.impute_mode(_raw(spark, sf_dir), CAT_GAPS).select("event_id", *CAT_GAPS)


@query("c4_forward_fill", with_ctes(
    "SELECT event_id, last_value(cvss_base_score IGNORE NULLS) OVER (PARTITION BY source_type "
    "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cvss_ffill "
    "FROM raw", raw=True))
def c4_forward_fill(spark, sf_dir):
    d = clean.forward_fill(_raw(spark, sf_dir), "cvss_base_score", ["ts", "event_id"],
                           ["source_type"], out="cvss_ffill")
    return d.select("event_id", "cvss_ffill")


@query("c5_assert_complete", with_ctes("SELECT count(*) AS rows FROM imp", raw=True,
                                       extra=PREP_CTES))
def c5_assert_complete(spark, sf_dir):
    imp = clean.impute_mode(clean.impute_median(_raw(spark, sf_dir), NUM_GAPS), CAT_GAPS)
    return clean.assert_complete(imp).agg(F.count(F.lit(1)).alias("rows"))


@query("c6_count_duplicates", with_ctes(
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) "
    "AS duplicate_rows FROM raw", raw=True))
def c6_count_duplicates(spark, sf_dir):
    return clean.count_duplicates(_raw(spark, sf_dir))


@query("c7_dedupe", with_ctes("SELECT DISTINCT * EXCLUDE (_o) FROM raw", raw=True))
def c7_dedupe(spark, sf_dir):
    return clean.dedupe(_raw(spark, sf_dir).drop("_o"))


@query("c8_clamp", with_ctes(
    "SELECT event_id, CASE WHEN ssl_days_remaining IS NOT NULL THEN "
    "least(greatest(ssl_days_remaining, 0), 365) END AS ssl_clamped FROM raw",
    raw=True))
def c8_clamp(spark, sf_dir):
    d = clean.clamp(_raw(spark, sf_dir), "ssl_days_remaining", 0, 365, out="ssl_clamped")
    return d.select("event_id", "ssl_clamped")


@query("c9_dataset_summary", with_ctes(
    "SELECT count(*) AS rows, 25 AS columns, min(ts) AS ts_min, max(ts) AS ts_max FROM raw",
    raw=True))
def c9_dataset_summary(spark, sf_dir):
    return profile.dataset_summary(_raw(spark, sf_dir).drop("_o"), "ts")


_C9_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT"}


@query("c9_column_types", with_ctes(
    "SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS column, column_type AS type FROM "
    "(DESCRIBE SELECT * EXCLUDE (_o) FROM raw)", raw=True))
def c9_column_types(spark, sf_dir):
    """Types under their SQL names."""
    t = profile.column_types(_raw(spark, sf_dir).drop("_o"))
    return t.select("position", "column", lookup("type", _C9_TYPES).alias("type"))


@query("c10_preprocess_report", with_ctes(
    "SELECT * FROM (VALUES ('nulls_imputed', (SELECT CAST(" + " + ".join(
        f"count(*) - count({c})" for c in RAW_COLS) + " AS BIGINT) FROM raw)), "
    "('rows_raw', (SELECT count(*) FROM raw)), ('rows_deduplicated', (SELECT count(*) FROM dd)), "
    "('outlier_rows', (SELECT CAST(sum(is_outlier) AS BIGINT) FROM flagged)), "
    "('rows_final', (SELECT count(*) FROM flagged)), ('columns_final', 53)) t(step, value)",
    raw=True, extra=PREP_CTES + ",\n" + _Q + ",\n" + _FLAG))
def c10_preprocess_report(spark, sf_dir):
    raw = _raw(spark, sf_dir).drop("_o")
    cleaned = clean_events(raw, NUM_GAPS, CAT_GAPS)
    flagged = outliers.flag_outliers(encode.encode_all(cleaned))
    return profile.preprocess_report(raw, cleaned, flagged)


# ---- D: encoding and scaling -------------------------------------------------
@query("d1_encode_severity", with_ctes(
    "SELECT event_id, leak_severity, CAST(" + _SEV + " AS INTEGER) AS leak_severity_encoded "
    "FROM raw", raw=True))
def d1_encode_severity(spark, sf_dir):
    return encode.encode_severity(_raw(spark, sf_dir)).select(
        "event_id", "leak_severity", "leak_severity_encoded")


@query("d2_encode_maturity", with_ctes(
    "SELECT event_id, exploit_maturity, CAST(" + _MAT + " AS INTEGER) AS exploit_maturity_encoded "
    "FROM raw", raw=True))
def d2_encode_maturity(spark, sf_dir):
    return encode.encode_maturity(_raw(spark, sf_dir)).select(
        "event_id", "exploit_maturity", "exploit_maturity_encoded")


@query("d3_one_hot_source", with_ctes(
    "SELECT event_id, " + ", ".join(
        f"CAST(coalesce(source_type = '{v}', false) AS INTEGER) AS source_{v}"
        for v in SOURCE_TYPES) + " FROM raw", raw=True))
def d3_one_hot_source(spark, sf_dir):
    d = encode.one_hot(_raw(spark, sf_dir), "source_type", "source", categories=None)
    return d.select("event_id", *[f"source_{v}" for v in SOURCE_TYPES])


@query("d4_one_hot_artifact", with_ctes(
    "SELECT event_id, " + ", ".join(
        f"CAST(coalesce(artifact_type = '{v}', false) AS INTEGER) AS artifact_{v}"
        for v in ARTIFACT_TYPES) + " FROM raw", raw=True))
def d4_one_hot_artifact(spark, sf_dir):
    d = encode.one_hot_artifact(_raw(spark, sf_dir))
    return d.select("event_id", *[f"artifact_{v}" for v in ARTIFACT_TYPES])


@query("d5_encode_domain", with_ctes(
    "SELECT event_id, domain, CAST(dense_rank() OVER (ORDER BY domain) - 1 AS INTEGER) "
    "AS domain_encoded FROM raw", raw=True))
def d5_encode_domain(spark, sf_dir):
    return encode.encode_label(_raw(spark, sf_dir), "domain").select(
        "event_id", "domain", "domain_encoded")


_ST = ("st AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
    for c in SCALE_FEATURES) + " FROM enc)")


def _z(c):
    return (f"(CAST({c} AS DOUBLE) - (SELECT m_{c} FROM st)) / (SELECT CASE WHEN s_{c} = 0 "
            f"OR s_{c} IS NULL THEN 1e0 ELSE s_{c} END FROM st)")


@query("d6_scale", with_ctes(
    "SELECT event_id, " + ", ".join(f"round({_z(c)}, 6) AS {c}" for c in SCALE_FEATURES)
    + " FROM enc", raw=True, extra=PREP_CTES + ",\n" + _ST))
def d6_scale(spark, sf_dir):
    d = encode.scale(_prep(spark, sf_dir, flag=False), SCALE_FEATURES)
    return d.select("event_id", *[rounded(c, 6).alias(c) for c in SCALE_FEATURES])


@query("d7_scale_check", with_ctes(
    "SELECT feature, round(mean, 6) + 0e0 AS mean, round(std, 6) AS std FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(z) AS mean, stddev_samp(z) AS std FROM "
        f"(SELECT {_z(c)} AS z FROM enc)" for c in SCALE_FEATURES) + ")",
    raw=True, extra=PREP_CTES + ",\n" + _ST))
def d7_scale_check(spark, sf_dir):
    d = encode.scale(_prep(spark, sf_dir, flag=False), SCALE_FEATURES)
    chk = encode.scale_check(d, SCALE_FEATURES)
    return chk.select("feature", (F.round("mean", 6) + F.lit(0.0)).alias("mean"),
                      F.round("std", 6).alias("std"))


# ---- E: outliers ------------------------------------------------------------------
@query("e1_iqr_bounds", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, q1_{c} AS q1, q3_{c} AS q3, q3_{c}-q1_{c} AS iqr, "
        f"q1_{c} - 1.5e0*(q3_{c}-q1_{c}) AS lower, q3_{c} + 1.5e0*(q3_{c}-q1_{c}) AS upper FROM qs"
        for c in OUTLIER_FEATURES) + ")", raw=True, extra=PREP_CTES + ",\n" + _Q))
def e1_iqr_bounds(spark, sf_dir):
    return outliers.iqr_bounds(_prep(spark, sf_dir, flag=False), OUTLIER_FEATURES)


@query("e2_outlier_report", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count_if({_outside(c)}) AS BIGINT) AS iqr_outliers, "
        f"CAST(count_if(abs(({c} - (SELECT m_{c} FROM qs)) / (SELECT s_{c} FROM qs)) > 3e0) AS BIGINT) AS z_outliers, "
        f"min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM enc"
        for c in OUTLIER_FEATURES) + ") WHERE iqr_outliers > 0 OR z_outliers > 0",
    raw=True, extra=PREP_CTES + ",\n" + _Q))
def e2_outlier_report(spark, sf_dir):
    return outliers.outlier_report(_prep(spark, sf_dir, flag=False), OUTLIER_FEATURES)


@query("e5_flag_outliers", with_ctes(
    "SELECT event_id, is_outlier FROM flagged", raw=True,
    extra=PREP_CTES + ",\n" + _Q + ",\n" + _FLAG))
def e5_flag_outliers(spark, sf_dir):
    return _prep(spark, sf_dir).select("event_id", "is_outlier")


@query("e6_outlier_rate", with_ctes(
    "SELECT count(*) AS rows, CAST(sum(is_outlier) AS BIGINT) AS outlier_rows, "
    "round(sum(is_outlier) * 100e0 / count(*), 6) AS outlier_pct FROM flagged", raw=True,
    extra=PREP_CTES + ",\n" + _Q + ",\n" + _FLAG))
def e6_outlier_rate(spark, sf_dir):
    r = outliers.outlier_rate(_prep(spark, sf_dir))
    return r.select("rows", "outlier_rows", F.round("outlier_pct", 6).alias("outlier_pct"))


# ---- H3 / H13 -----------------------------------------------------------------
DESCRIBE_COLS = ["subdomain_count", "subdomain_age_days", "domain_reputation_score",
                 "cvss_base_score", "exploit_availability", "cve_age_days", "exposure_frequency",
                 "has_credentials", "paste_site_mentions", "ssl_days_remaining",
                 "open_ports_count", "github_leak_count", "exposure_velocity", "risk_score"]


@query("h3_describe", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, "
        f"round(max(CAST({c} AS DOUBLE)), 6) AS max FROM dd" for c in DESCRIBE_COLS) + ")",
    raw=True, extra=PREP_CTES))
def h3_describe(spark, sf_dir):
    return profile.describe_numeric(clean_events(_raw(spark, sf_dir), NUM_GAPS, CAT_GAPS),
                                    DESCRIBE_COLS, digits=6)


@query("h13_preview", with_ctes(
    "SELECT event_id, ts, source_type, risk_score FROM dd ORDER BY ts, event_id LIMIT 5",
    raw=True, extra=PREP_CTES))
def h13_preview(spark, sf_dir):
    d = clean_events(_raw(spark, sf_dir), NUM_GAPS, CAT_GAPS)
    return profile.preview(d, 5, ["ts", "event_id"]).select("event_id", "ts", "source_type",
                                                             "risk_score")


@query("b1_feature_columns", with_ctes(
    "SELECT event_id, " + ", ".join(MODEL_FEATURES) + " FROM enc", raw=True, extra=PREP_CTES))
def b1_feature_columns(spark, sf_dir):
    """B1: the model feature projection (fixed base list + one-hot columns found by prefix)."""
    d = _prep(spark, sf_dir, flag=False)
    return d.select("event_id", *encode.feature_columns(d))
