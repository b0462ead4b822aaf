"""Rule scoring queries (F1-F6, F10, B2, B3) over the stand-in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposcope.functions.columns import risk_label
from exposcope.operators import risk
from exposcope.plans.catalog import query
from exposcope.plans.sqlbase import level_sql, with_ctes
from exposcope.sources.standin import exposure_clean, exposure_labeled

RISK_NAME_SQL = ("CASE risk_score WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' "
                 "WHEN 3 THEN 'Critical' WHEN 4 THEN 'Emergency' END")


@query("f1_risk_score", with_ctes(
    "SELECT event_id, round(risk_raw, 6) AS risk_raw, " + level_sql("risk_raw")
    + " AS risk_score FROM scored"))
def f1_risk_score(spark, sf_dir):
    df = risk.risk_score(exposure_clean(spark, sf_dir))
    return df.select("event_id", F.round("risk_raw", 6).alias("risk_raw"), "risk_score")


@query("b2_risk_label", with_ctes(
    "SELECT event_id, risk_score, " + RISK_NAME_SQL + " AS risk_label FROM labeled"))
def b2_risk_label(spark, sf_dir):
    df = exposure_labeled(spark, sf_dir)
    return df.select("event_id", "risk_score", risk_label("risk_score").alias("risk_label"))


@query("b3_filter_risk", with_ctes(
    "SELECT event_id, ts, risk_score FROM labeled WHERE risk_score = 3"))
def b3_filter_risk(spark, sf_dir):
    df = exposure_labeled(spark, sf_dir)
    return df.filter(risk_label("risk_score") == "Critical").select("event_id", "ts", "risk_score")
