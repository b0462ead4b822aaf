"""Rule-derived queries F2-F10 and B5 over the stand-in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposcope.operators import explain, risk
from exposcope.operators.encode import encode_maturity, encode_severity
from exposcope.operators.prepare import clean_events
from exposcope.plans.catalog import query
from exposcope.plans.prep_queries import CAT_GAPS, NUM_GAPS, PREP_CTES, _MAT, _SEV
from exposcope.plans.sqlbase import with_ctes
from exposcope.schema import ARTIFACT_TYPES, BASE_FEATURES, SOURCE_TYPES
from exposcope.sources.standin import exposure_clean, exposure_raw, scenarios

# ---- oracle helpers --------------------------------------------------------------
_TERMS_SQL = [
    ("cvss", "cvss_base_score/10e0*3e0"),
    ("exploit", "CASE WHEN exploit_availability=1 THEN 1.5e0 ELSE 0e0 END"),
    ("exploit_maturity", "CASE WHEN exploit_availability=1 THEN (CASE exploit_maturity WHEN "
     "'Weaponized' THEN 2e0 WHEN 'Functional' THEN 1e0 WHEN 'POC' THEN 0.5e0 ELSE 0e0 END) "
     "ELSE 0e0 END"),
    ("credentials", "CASE WHEN has_credentials=1 THEN 1.5e0 ELSE 0e0 END"),
    ("severity", "CASE leak_severity WHEN 'Low' THEN 0.2e0 WHEN 'Medium' THEN 0.6e0 WHEN 'High' "
     "THEN 1.2e0 WHEN 'Critical' THEN 2e0 ELSE 0e0 END"),
    ("reputation", "(1e0-domain_reputation_score)*1.5e0"),
    ("frequency", "least(1.5e0, exposure_frequency/10e0)"),
    ("velocity", "least(1e0, exposure_velocity/8e0)"),
    ("ct_anomaly", "CASE WHEN ct_log_anomaly=1 THEN 0.8e0 ELSE 0e0 END"),
    ("ssl", "CASE WHEN ssl_days_remaining<=0 THEN 1e0 WHEN ssl_days_remaining<=30 THEN 0.5e0 "
     "ELSE 0e0 END"),
    ("outdated", "CASE WHEN service_version_outdated=1 THEN 0.6e0 ELSE 0e0 END"),
    ("ports", "least(0.8e0, open_ports_count/50e0)"),
    ("github", "least(0.8e0, github_leak_count/10e0)"),
    ("paste", "least(0.6e0, paste_site_mentions/15e0)"),
    ("cve_age", "CASE WHEN cve_age_days>365 THEN 0.5e0 WHEN cve_age_days>180 THEN 0.3e0 "
     "ELSE 0e0 END"),
]
_PRED = (
    "pb AS (SELECT dd.*, CAST(" + _SEV + " AS INTEGER) AS leak_severity_encoded, CAST(" + _MAT
    + " AS INTEGER) AS exploit_maturity_encoded FROM dd),\n"
    "pa AS (SELECT pb.*, least(greatest(cvss_base_score/10e0*0.5e0 + leak_severity_encoded/3e0*0.3e0"
    " + 0.1e0, 0e0), 1e0) AS anomaly_score FROM pb),\n"
    "pr AS (SELECT * EXCLUDE (c), CAST(CASE WHEN c > 7 THEN 4 WHEN c > 5.5e0 THEN 3 WHEN c > 4 THEN 2 "
    "WHEN c > 2.5e0 THEN 1 ELSE 0 END AS INTEGER) AS predicted_risk, 0.75e0 AS confidence FROM "
    "(SELECT *, cvss_base_score*0.35e0 + leak_severity_encoded*1.2e0 + anomaly_score*3e0 AS c "
    "FROM pa))")
PRED_CTES = PREP_CTES + ",\n" + _PRED


def _fixed_sql(x: str, d: int) -> str:
    """C-style formatting of the double's exact value, ties to even."""
    return f"printf('%.{d}f', CAST({x} AS DOUBLE))"


def _display_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def pred_base(spark, sf_dir):
    """Cleaned, ordinal-encoded events scored by the rule path of F7."""
    d = encode_maturity(encode_severity(clean_events(exposure_raw(spark, sf_dir), NUM_GAPS,
                                                     CAT_GAPS)))
    return risk.predict_risk_rules(d)


# ---- queries ------------------------------------------------------------------------
@query("f2_risk_breakdown", with_ctes(
    "SELECT event_id, factor, round(contribution, 6) AS contribution, "
    "round(CASE WHEN risk_raw = 0 THEN 0e0 ELSE contribution / risk_raw END, 6) AS share, "
    "round(risk_raw, 6) AS risk_raw FROM (" + " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS factor, t_{n} AS contribution, risk_raw FROM t"
        for n, _ in _TERMS_SQL) + ")", labeled=False,
    extra="t0 AS (SELECT event_id, " + ", ".join(f"{e} AS t_{n}" for n, e in _TERMS_SQL)
    + " FROM clean),\nt AS (SELECT *, " + " + ".join(f"t_{n}" for n, _ in _TERMS_SQL)
    + " AS risk_raw FROM t0)"))
def f2_risk_breakdown(spark, sf_dir):
    b = risk.risk_breakdown(exposure_clean(spark, sf_dir), ["event_id"])
    return b.select("event_id", "factor", *[F.round(c, 6).alias(c) for c in
                                            ["contribution", "share", "risk_raw"]])


_RULES_SQL = [
    ("high_port_low_cvss", "open_ports_count >= 100 AND cvss_base_score <= 2e0"),
    ("weaponized_low_cvss", "exploit_availability = 1 AND exploit_maturity = 'Weaponized' "
     "AND cvss_base_score <= 3e0"),
    ("massive_paste_unknown", "paste_site_mentions >= 50 AND domain_reputation_score <= 0.15e0"),
    ("expired_ssl_high_rep", "ssl_days_remaining < 0 AND domain_reputation_score >= 0.85e0"),
    ("zero_day_pattern", "cvss_base_score >= 9e0 AND exploit_availability = 1 AND "
     "exploit_maturity = 'Weaponized' AND cve_age_days <= 7"),
]
_PAT_ARR = ("list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _RULES_SQL)
            + "], lambda x: x IS NOT NULL)")


@query("f3_tag_patterns", with_ctes(
    "SELECT event_id, array_to_string(p, ',') AS patterns, CAST(len(p) AS INTEGER) AS n_patterns "
    "FROM (SELECT event_id, " + _PAT_ARR + " AS p FROM clean)", labeled=False))
def f3_tag_patterns(spark, sf_dir):
    d = risk.tag_patterns(exposure_clean(spark, sf_dir))
    return d.select("event_id", F.array_join("patterns", ",").alias("patterns"),
                    F.size("patterns").alias("n_patterns"))


@query("f3_pattern_counts", with_ctes(
    "SELECT pattern, count(*) AS count FROM (SELECT unnest(" + _PAT_ARR + ") AS pattern "
    "FROM clean) GROUP BY 1", labeled=False))
def f3_pattern_counts(spark, sf_dir):
    d = risk.tag_patterns(exposure_clean(spark, sf_dir))
    return (d.select(F.explode("patterns").alias("pattern")).groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("count")))


@query("f4_heuristic_anomaly", with_ctes(
    "SELECT event_id, round(least(greatest(cvss_base_score/10e0*0.5e0 + CAST(" + _SEV
    + " AS INTEGER)/3e0*0.3e0 + 0.1e0, 0e0), 1e0), 6) AS anomaly_score FROM clean",
    labeled=False))
def f4_heuristic_anomaly(spark, sf_dir):
    d = risk.heuristic_anomaly(exposure_clean(spark, sf_dir))
    return d.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"))


def _rhe_sql(x: str, d: int) -> str:
    p = f"{float(10 ** d)!r}"
    y = f"(({x})*{p})"
    r = (f"(CASE WHEN {y} - floor({y}) > 0.5e0 THEN floor({y}) + 1 WHEN {y} - floor({y}) < 0.5e0 "
         f"THEN floor({y}) ELSE (CASE WHEN floor({y}) % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 "
         f"END) END)")
    return f"({r} / {p})" if d else f"CAST({r} AS DOUBLE)"


_SC_SRC = {"GitHub": "GitHub", "DNS": "DNS", "CVE": "CVE", "Paste Site": "Paste",
           "CT Logs": "CT_Log"}
_SC_ART = {"GitHub": "Password", "CVE": "CVE_Entry", "DNS": "Subdomain",
           "Paste Site": "Credential_Leak", "CT Logs": "Certificate"}


def _case(col, mapping, default="NULL"):
    return ("CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
            + f" ELSE {default} END")


_SCEN_COLS = [
    "15 AS subdomain_count", "205 AS subdomain_age_days",
    "greatest(0e0, 1e0 - cvss/10e0*0.6e0 + 0e0) AS domain_reputation_score",
    "cvss AS cvss_base_score",
    "CASE WHEN cvss > 7 THEN 1 ELSE 0 END AS exploit_availability", "402 AS cve_age_days",
    "CAST(greatest(1, CAST(trunc(leak*1.5e0 + 2) AS BIGINT)) AS INTEGER) AS exposure_frequency",
    "CASE WHEN leak > 6 THEN 1 ELSE 0 END AS has_credentials",
    "CAST(greatest(0, CAST(trunc(leak*2 + 2) AS BIGINT)) AS INTEGER) AS paste_site_mentions",
    "0 AS ct_log_anomaly",
    "CAST(greatest(-60, CAST(trunc(200 - cvss*25 + 0) AS BIGINT)) AS INTEGER) AS ssl_days_remaining",
    "10 AS open_ports_count", "CASE WHEN cvss > 5 THEN 1 ELSE 0 END AS service_version_outdated",
    "5 AS dns_record_type_count", "0 AS is_wildcard_dns",
    "CAST(greatest(0, CAST(trunc(leak*1.2e0 + 1) AS BIGINT)) AS INTEGER) AS github_leak_count",
    _rhe_sql("leak*cvss/10e0 + 0.5e0", 2) + " AS exposure_velocity",
    "CAST(CASE WHEN li <= 2 THEN 0 WHEN li <= 5 THEN 1 WHEN li <= 8 THEN 2 ELSE 3 END AS INTEGER) "
    "AS leak_severity_encoded",
    "CAST(least(3, CAST(trunc(cvss/3e0) AS BIGINT)) AS INTEGER) AS exploit_maturity_encoded",
] + [f"CASE WHEN src = '{v}' THEN 1 ELSE 0 END AS source_{v}" for v in SOURCE_TYPES] + [
    f"CASE WHEN art = '{v}' THEN 1 ELSE 0 END AS artifact_{v}" for v in ARTIFACT_TYPES]

_SCEN_CTE = (
    "sc AS (SELECT CONCAT_WS('-', CAST(o AS STRING), CAST(n AS STRING), CAST(p AS STRING), "
    "CAST(s AS STRING), CAST(q AS STRING)) AS event_id, CAST(q % 21 AS DOUBLE) / 2 AS leak, "
    "CAST((p*7+o*3+n)%101 AS DOUBLE)/10 AS cvss, CASE p%5 WHEN 0 THEN 'CT Logs' WHEN 1 THEN 'CVE' "
    "WHEN 2 THEN 'DNS' WHEN 3 THEN 'GitHub' ELSE 'Paste Site' END AS source_type FROM k),\n"
    "sc2 AS (SELECT *, CAST(" + _rhe_sql("leak", 0) + " AS INTEGER) AS li, "
    + _case("source_type", _SC_SRC) + " AS src, " + _case("source_type", _SC_ART, "'Config'")
    + " AS art FROM sc)")


@query("f5_expand_scenarios", with_ctes(
    "SELECT event_id, " + ", ".join(_SCEN_COLS) + " FROM sc2", labeled=False, extra=_SCEN_CTE))
def f5_expand_scenarios(spark, sf_dir):
    d = risk.expand_scenarios(scenarios(spark, sf_dir), "leak", "cvss", "source_type")
    return d.drop("leak", "cvss", "source_type")


@query("f6_heuristic_risk", with_ctes("SELECT event_id, predicted_risk FROM pr", raw=True,
                                      extra=PRED_CTES))
def f6_heuristic_risk(spark, sf_dir):
    return pred_base(spark, sf_dir).select("event_id", "predicted_risk")


@query("f7_predict_rules", with_ctes(
    "SELECT event_id, predicted_risk, " + "CASE predicted_risk WHEN 0 THEN 'Low' WHEN 1 THEN "
    "'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' WHEN 4 THEN 'Emergency' END AS risk_level, "
    "round(anomaly_score, 6) AS anomaly_score, confidence FROM pr", raw=True, extra=PRED_CTES))
def f7_predict_rules(spark, sf_dir):
    d = pred_base(spark, sf_dir)
    return d.select("event_id", "predicted_risk", "risk_level",
                    F.round("anomaly_score", 6).alias("anomaly_score"), "confidence")


def _say_sql(text: str, value: str | None = None) -> str:
    before, _, after = text.replace("'", "''").partition("{}")
    return f"'{before}'" if value is None else f"'{before}' || {value} || '{after}'"


def _whole_sql(c: str) -> str:
    return f"CAST(trunc({c}) AS BIGINT)"


def _case_sql(branches, last: str | None = None) -> str:
    body = " ".join(f"WHEN {c} THEN {t}" for c, t in branches)
    return f"CASE {body}" + (f" ELSE {last}" if last else "") + " END"


_H, _A, _Y = explain.HEADLINES, explain.RECOMMENDATIONS, explain.REASONS
_PASTE, _REPO, _SSL = map(_whole_sql, ("paste_site_mentions", "github_leak_count", "ssl_days_remaining"))
_REASON_ROWS = [
    [("cvss_base_score >= 8", _say_sql(_Y["cvss_top"], _fixed_sql("cvss_base_score", 1))),
     ("cvss_base_score >= 6", _say_sql(_Y["cvss_high"], _fixed_sql("cvss_base_score", 1)))],
    [("anomaly_score > 0.7e0", _say_sql(_Y["anomaly"], _fixed_sql("anomaly_score", 2)))],
    [("leak_severity_encoded >= 3", _say_sql(_Y["severity_top"])), ("leak_severity_encoded >= 2", _say_sql(_Y["severity_high"]))],
    [("has_credentials = 1", _say_sql(_Y["credentials"]))],
    [(f"{_PASTE} > 5", _say_sql(_Y["paste"], f"CAST({_PASTE} AS VARCHAR)"))],
    [(f"{_REPO} > 3", _say_sql(_Y["repositories"], f"CAST({_REPO} AS VARCHAR)"))],
    [(f"{_SSL} < 0", _say_sql(_Y["ssl_over"], f"CAST(abs({_SSL}) AS VARCHAR)")),
     (f"{_SSL} < 30", _say_sql(_Y["ssl_soon"], f"CAST({_SSL} AS VARCHAR)"))],
    [("exposure_velocity > 3", _say_sql(_Y["velocity"], _fixed_sql("exposure_velocity", 1)))],
]
_INSIGHT_CTE = (
    "ins AS (SELECT event_id, "
    + _case_sql([("predicted_risk >= 4", _say_sql(_H[4], _fixed_sql("confidence * 100e0", 0)))]
                + [(f"predicted_risk = {k}", _say_sql(_H[k])) for k in (3, 2, 1)], _say_sql(_H[0])) + " AS headline, "
    "nullif(concat_ws(', ', " + ", ".join(map(_case_sql, _REASON_ROWS)) + "), '') AS factors, "
    + _case_sql([("predicted_risk >= 3", _say_sql(_A[3])), ("predicted_risk = 2", _say_sql(_A[2])),
                 ("predicted_risk = 1", _say_sql(_A[1]))], _say_sql(_A[0])) + " AS recommendation FROM pr)")


@query("f8_insights", with_ctes(
    "SELECT event_id, headline, factors, recommendation, concat_ws(chr(10) || chr(10), headline, "
    f"'{explain.SECTIONS[0]}' || factors || '.', '{explain.SECTIONS[1]}' || recommendation) AS insight FROM ins", raw=True,
    extra=PRED_CTES + ",\n" + _INSIGHT_CTE))
def f8_insights(spark, sf_dir):
    d = explain.insights(pred_base(spark, sf_dir))
    return d.select("event_id", "headline", "factors", "recommendation", "insight")


_TOP8 = sorted(explain.rule_importances().items(), key=lambda kv: (-kv[1], kv[0]))[:8]
_EXPL_FEATS = [c for c in BASE_FEATURES + ["anomaly_score"]]


@query("f9_explain", with_ctes(
    "SELECT l.event_id, l.feature, " + _display_sql("l.feature") + " AS display_name, l.value, "
    "i.importance, CASE WHEN i.importance > 0.1e0 THEN 'High' WHEN i.importance > 0.04e0 THEN "
    "'Medium' ELSE 'Low' END AS impact FROM (" + " UNION ALL ".join(
        f"SELECT event_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM pr"
        for c in _EXPL_FEATS) + ") l JOIN (VALUES " + ", ".join(
        f"('{k}', {v!r}e0)" for k, v in _TOP8 if v > 0.01) + ") i(feature, importance) "
    "ON l.feature = i.feature", raw=True, extra=PRED_CTES))
def f9_explain(spark, sf_dir):
    d = pred_base(spark, sf_dir)
    imp = explain.importance_table(spark)
    e = explain.explain(d, imp, ["event_id"])
    return e.select("event_id", "feature", "display_name", "value", "importance", "impact")


@query("f10_bands", with_ctes(
    "SELECT event_id, CASE WHEN anomaly_score < 0.3e0 THEN 'low' WHEN anomaly_score < 0.6e0 THEN "
    "'moderate' WHEN anomaly_score < 0.8e0 THEN 'elevated' ELSE 'severe' END AS anomaly_band, "
    "CAST(predicted_risk >= 3 AS INTEGER) AS risk_alert, CAST(anomaly_score > 0.6e0 AS INTEGER) "
    "AS anomaly_alert, CAST(confidence > 0.7e0 AS INTEGER) AS confident FROM pr", raw=True,
    extra=PRED_CTES))
def f10_bands(spark, sf_dir):
    d = risk.with_bands(pred_base(spark, sf_dir), risk_col="predicted_risk")
    return d.select("event_id", "anomaly_band", "risk_alert", "anomaly_alert", "confident")


@query("f10_importance_bands", "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{'top' if v > 0.1 else 'high' if v > 0.05 else 'mid' if v > 0.03 else 'low'}')"
    for f, v in explain.rule_importances().items()) + ") t(feature, band)")
def f10_importance_bands(spark, sf_dir):
    """Bands of the rule's importances, for the features that the events have."""
    have = pred_base(spark, sf_dir).columns
    t = explain.importance_table(spark).where(F.col("feature").isin(have))
    return t.select("feature", risk.importance_band("importance").alias("band"))


@query("b5_features_long", with_ctes(
    "SELECT event_id, feature, " + _display_sql("feature") + " AS display_name, value FROM ("
    + " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM pr"
                         for c in _EXPL_FEATS) + ")", raw=True, extra=PRED_CTES))
def b5_features_long(spark, sf_dir):
    return explain.features_long(pred_base(spark, sf_dir), ["event_id"], _EXPL_FEATS).select(
        "event_id", "feature", "display_name", "value")
