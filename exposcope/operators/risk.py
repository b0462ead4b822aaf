"""Rule-based risk scoring (F1-F6, F10) as pure column expressions.

Everything here compiles into whole-stage codegen: no shuffle, no UDF, so a
score over 100 TB is one map-only scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposcope.functions.columns import bind, lookup, ordinal_code, round_half_even
from exposcope.schema import (
    MATURITY_BONUS, RISK_CUTS, SCENARIO_ARTIFACT, SEVERITY_ORDER,
    SEVERITY_WEIGHT, SOURCE_ALIAS, SOURCE_TYPES, ARTIFACT_TYPES,
)

# Term names in the order they are added (double addition is order-dependent).
RISK_TERMS = [
    "cvss", "exploit", "exploit_maturity", "credentials", "severity", "reputation",
    "frequency", "velocity", "ct_anomaly", "ssl", "outdated", "ports", "github",
    "paste", "cve_age",
]


def risk_terms(df: DataFrame | None = None) -> list[tuple[str, Column]]:
    """Each additive term of the raw risk score as (name, column)."""
    c = F.col
    avail = c("exploit_availability") == 1
    mat = c("exploit_maturity")
    ssl = c("ssl_days_remaining")
    age = c("cve_age_days")
    return [
        ("cvss", c("cvss_base_score") / 10.0 * 3.0),
        ("exploit", F.when(avail, F.lit(1.5)).otherwise(F.lit(0.0))),
        ("exploit_maturity", F.when(avail, lookup(mat, MATURITY_BONUS, 0.0)).otherwise(F.lit(0.0))),
        ("credentials", F.when(c("has_credentials") == 1, F.lit(1.5)).otherwise(F.lit(0.0))),
        ("severity", lookup(c("leak_severity"), SEVERITY_WEIGHT, 0.0)),
        ("reputation", (1.0 - c("domain_reputation_score")) * 1.5),
        ("frequency", F.least(F.lit(1.5), c("exposure_frequency") / 10.0)),
        ("velocity", F.least(F.lit(1.0), c("exposure_velocity") / 8.0)),
        ("ct_anomaly", F.when(c("ct_log_anomaly") == 1, F.lit(0.8)).otherwise(F.lit(0.0))),
        ("ssl", F.when(ssl <= 0, F.lit(1.0)).when(ssl <= 30, F.lit(0.5)).otherwise(F.lit(0.0))),
        ("outdated", F.when(c("service_version_outdated") == 1, F.lit(0.6)).otherwise(F.lit(0.0))),
        ("ports", F.least(F.lit(0.8), c("open_ports_count") / 50.0)),
        ("github", F.least(F.lit(0.8), c("github_leak_count") / 10.0)),
        ("paste", F.least(F.lit(0.6), c("paste_site_mentions") / 15.0)),
        ("cve_age", F.when(age > 365, F.lit(0.5)).when(age > 180, F.lit(0.3)).otherwise(F.lit(0.0))),
    ]


def raw_risk(terms: list[tuple[str, Column]] | None = None) -> Column:
    """Left-to-right sum of the terms (same order as the published rule)."""
    terms = terms or risk_terms()
    total = terms[0][1]
    for _, t in terms[1:]:
        total = total + t
    return total


def risk_level(raw: Column) -> Column:
    """Raw score -> level 0..4 at the fixed cut points; null stays null."""
    lvl = F.when(raw.isNull(), F.lit(None))
    for i, cut in enumerate(RISK_CUTS):
        lvl = lvl.when(raw < cut, F.lit(i))
    return lvl.otherwise(F.lit(len(RISK_CUTS))).cast("int")


def risk_score(df: DataFrame, out: str = "risk_score", keep_raw: bool = True,
               raw_col: str = "risk_raw") -> DataFrame:
    """F1: weighted raw score and level 0..4 (deterministic, no noise)."""
    raw = raw_risk()
    if keep_raw:
        return df.withColumn(raw_col, raw).withColumn(out, risk_level(F.col(raw_col)))
    # the level asks for the score at every cut: bound once, or the generated method of the
    # scan grows beyond what the JVM compiles
    return df.withColumn(out, bind(raw, risk_level))


def risk_breakdown(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """one row per (event, term): contribution and share of the raw total."""
    terms = risk_terms()
    wide = df.select(*id_cols, *[t.alias(f"t_{n}") for n, t in terms])
    wide = wide.withColumn("risk_raw", raw_risk([(n, F.col(f"t_{n}")) for n, _ in terms]))
    long = wide.unpivot(id_cols + ["risk_raw"], [f"t_{n}" for n, _ in terms],
                        "factor", "contribution")
    return (long.withColumn("factor", F.substring(F.col("factor"), 3, 64))
            .withColumn("share", F.when(F.col("risk_raw") == 0, F.lit(0.0))
                        .otherwise(F.col("contribution") / F.col("risk_raw"))))


# Named inconsistent patterns (detection form of the injected anomalies).
PATTERN_NAMES = ["high_port_low_cvss", "weaponized_low_cvss", "massive_paste_unknown",
                 "expired_ssl_high_rep", "zero_day_pattern"]


def pattern_rules() -> list[tuple[str, Column]]:
    c = F.col
    avail = c("exploit_availability") == 1
    weap = c("exploit_maturity") == "Weaponized"
    rep = c("domain_reputation_score")
    return [
        ("high_port_low_cvss", (c("open_ports_count") >= 100) & (c("cvss_base_score") <= 2.0)),
        ("weaponized_low_cvss", avail & weap & (c("cvss_base_score") <= 3.0)),
        ("massive_paste_unknown", (c("paste_site_mentions") >= 50) & (rep <= 0.15)),
        ("expired_ssl_high_rep", (c("ssl_days_remaining") < 0) & (rep >= 0.85)),
        ("zero_day_pattern", (c("cvss_base_score") >= 9.0) & avail & weap
         & (c("cve_age_days") <= 7)),
    ]


def tag_patterns(df: DataFrame, out: str = "patterns") -> DataFrame:
    """array<string> of the rules each row matches (empty when none)."""
    arr = F.array(*[F.when(rule, F.lit(name)) for name, rule in pattern_rules()])
    return df.withColumn(out, F.filter(arr, lambda x: x.isNotNull()))


def heuristic_anomaly(df: DataFrame, jitter: float = 0.1, out: str = "anomaly_score") -> DataFrame:
    """clip(cvss/10*0.5 + severity_code/3*0.3 + jitter, 0, 1).

    The jitter stands for the uniform [0, 0.2) noise; its midpoint by default.
    """
    sev = ordinal_code("leak_severity", SEVERITY_ORDER) if "leak_severity_encoded" not in df.columns \
        else F.col("leak_severity_encoded")
    v = F.col("cvss_base_score") / 10.0 * 0.5 + sev / 3.0 * 0.3 + F.lit(jitter)
    return df.withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def heuristic_risk(df: DataFrame, anomaly_col: str = "anomaly_score",
                   out: str = "predicted_risk") -> DataFrame:
    """cvss*0.35 + severity*1.2 + anomaly*3 cut at 2.5 / 4 / 5.5 / 7 (strict >)."""
    sev = F.col("leak_severity_encoded") if "leak_severity_encoded" in df.columns \
        else ordinal_code("leak_severity", SEVERITY_ORDER)
    combo = F.col("cvss_base_score") * 0.35 + sev * 1.2 + F.col(anomaly_col) * 3.0
    lvl = (F.when(combo > 7, 4).when(combo > 5.5, 3).when(combo > 4, 2)
           .when(combo > 2.5, 1).otherwise(0))
    return df.withColumn(out, F.when(combo.isNull(), None).otherwise(lvl).cast("int"))


def _trunc_int(c: Column) -> Column:
    """Python int(): truncation toward zero."""
    return c.cast("long")


def expand_scenarios(df: DataFrame, leak_col: str = "leak_severity", cvss_col: str = "cvss",
                     source_col: str = "source_type") -> DataFrame:
    """scenario (leak 0..10, cvss 0..10, UI source name) -> full feature row.

    Random terms of the interactive form are replaced by their midpoints, so the
    expansion is deterministic.
    """
    c = F.col
    leak = c(leak_col).cast("double")
    cvss = c(cvss_col).cast("double")
    leak_int = round_half_even(leak).cast("int")
    sev_enc = (F.when(leak_int <= 2, 0).when(leak_int <= 5, 1).when(leak_int <= 8, 2)
               .otherwise(3)).cast("int")
    src = lookup(c(source_col), SOURCE_ALIAS)
    art = lookup(c(source_col), SCENARIO_ARTIFACT, "Config")
    cols = {
        "subdomain_count": F.lit(15),
        "subdomain_age_days": F.lit(205),
        "domain_reputation_score": F.greatest(F.lit(0.0), 1.0 - cvss / 10.0 * 0.6 + 0.0),
        "cvss_base_score": cvss,
        "exploit_availability": F.when(cvss > 7, 1).otherwise(0),
        "cve_age_days": F.lit(402),
        "exposure_frequency": F.greatest(F.lit(1), _trunc_int(leak * 1.5 + 2).cast("int")),
        "has_credentials": F.when(leak > 6, 1).otherwise(0),
        "paste_site_mentions": F.greatest(F.lit(0), _trunc_int(leak * 2 + 2).cast("int")),
        "ct_log_anomaly": F.lit(0),
        "ssl_days_remaining": F.greatest(F.lit(-60), _trunc_int(200 - cvss * 25 + 0).cast("int")),
        "open_ports_count": F.lit(10),
        "service_version_outdated": F.when(cvss > 5, 1).otherwise(0),
        "dns_record_type_count": F.lit(5),
        "is_wildcard_dns": F.lit(0),
        "github_leak_count": F.greatest(F.lit(0), _trunc_int(leak * 1.2 + 1).cast("int")),
        "exposure_velocity": round_half_even(leak * cvss / 10.0 + 0.5, 2),
        "leak_severity_encoded": sev_enc,
        "exploit_maturity_encoded": F.least(F.lit(3), _trunc_int(cvss / 3.0).cast("int")),
    }
    for v in SOURCE_TYPES:
        cols[f"source_{v}"] = F.when(src == v, 1).otherwise(0)
    for v in ARTIFACT_TYPES:
        cols[f"artifact_{v}"] = F.when(art == v, 1).otherwise(0)
    return df.withColumns(cols)


def predict_risk_rules(df: DataFrame, jitter: float = 0.1, confidence: float = 0.75,
                       out: str = "predicted_risk") -> DataFrame:
    """F7 without trained models: F4 anomaly, F6 level, the midpoint confidence
    of the rule path, and the level name."""
    from exposcope.functions.columns import risk_label
    d = heuristic_anomaly(df, jitter)
    d = heuristic_risk(d, "anomaly_score", out)
    return d.withColumns({"confidence": F.lit(confidence),
                          "risk_level": risk_label(F.col(out))})


def with_bands(df: DataFrame, anomaly_col: str = "anomaly_score", risk_col: str = "risk_score",
               confidence_col: str | None = "confidence") -> DataFrame:
    """display bands and status flags."""
    a = F.col(anomaly_col)
    out = df.withColumns({
        "anomaly_band": F.when(a.isNull(), None).when(a < 0.3, "low").when(a < 0.6, "moderate")
        .when(a < 0.8, "elevated").otherwise("severe"),
        "risk_alert": (F.col(risk_col) >= 3).cast("int"),
        "anomaly_alert": (a > 0.6).cast("int"),
    })
    if confidence_col and confidence_col in df.columns:
        out = out.withColumn("confident", (F.col(confidence_col) > 0.7).cast("int"))
    return out


def importance_band(c: str | Column) -> Column:
    """Importance colour band: >0.1 top, >0.05 high, >0.03 mid, else low."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.when(x > 0.1, "top").when(x > 0.05, "high").when(x > 0.03, "mid")
            .otherwise("low"))


# Level centres of the rule combo (midpoints between its cut points 2.5 / 4 / 5.5 / 7).
RULE_CENTRES = [1.75, 3.25, 4.75, 6.25, 7.75]


def rule_combo(df: DataFrame, anomaly_col: str = "anomaly_score") -> Column:
    sev = F.col("leak_severity_encoded") if "leak_severity_encoded" in df.columns \
        else ordinal_code("leak_severity", SEVERITY_ORDER)
    return F.col("cvss_base_score") * 0.35 + sev * 1.2 + F.col(anomaly_col) * 3.0


def rule_probabilities(df: DataFrame, anomaly_col: str = "anomaly_score",
                       prefix: str = "prob_", digits: int = 4) -> DataFrame:
    """Class scores of the rule path: inverse-square distance of the combo to
    each level centre, normalised to sum 1 and rounded (ties are intended)."""
    from exposcope.functions.columns import bind
    centres = F.array(*[F.lit(float(c)) for c in RULE_CENTRES])

    def weights(cb):
        return F.transform(centres, lambda c: 1.0 / (1.0 + (cb - c) * (cb - c)))

    def normalise(ws):
        total = ws[0]
        for i in range(1, len(RULE_CENTRES)):
            total = total + ws[i]
        return bind(total, lambda t: F.transform(ws, lambda w: round_half_even(w / t, digits)))

    probs = bind(rule_combo(df, anomaly_col), lambda cb: bind(weights(cb), normalise))
    d = df.withColumn("__probs", probs)
    return d.withColumns({f"{prefix}{i}": F.col("__probs")[i]
                          for i in range(len(RULE_CENTRES))}).drop("__probs")
