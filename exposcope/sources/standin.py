"""Deterministic exposure-event tables derived from the provided ``lineitem``.

The test tables carry no exposure events, so ``exposure_clean`` maps every
lineitem row to one event with integer arithmetic only (both Spark and DuckDB
agree bit for bit).  ``exposure_raw`` then adds gaps and full-row duplicates,
so that cleaning operators have work.  Work grows with ``lineitem``: nothing
is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposcope.operators.risk import risk_score
from exposcope.sources.io import read_table

# Column expressions of the stand-in event (fixed mapping, also used as SQL text
# by the DuckDB oracle).  o = order key, p = part key, s = supplier key,
# n = line number, q = quantity.
_KEYS = [
    "l_orderkey AS o", "l_partkey AS p", "l_suppkey AS s",
    "CAST(l_linenumber AS BIGINT) AS n", "CAST(l_quantity AS BIGINT) AS q", "l_shipdate",
]
_EVENT = [
    "CONCAT_WS('-', CAST(o AS STRING), CAST(n AS STRING), CAST(p AS STRING), "
    "CAST(s AS STRING), CAST(q AS STRING)) AS event_id",
    "l_shipdate AS ts",
    "CASE p%5 WHEN 0 THEN 'CT_Log' WHEN 1 THEN 'CVE' WHEN 2 THEN 'DNS' "
    "WHEN 3 THEN 'GitHub' ELSE 'Paste' END AS source_type",
    """CASE p%5
    WHEN 0 THEN CASE o%3 WHEN 0 THEN 'Certificate' WHEN 1 THEN 'Cert_Anomaly' ELSE 'Wildcard_Cert' END
    WHEN 1 THEN CASE o%3 WHEN 0 THEN 'CVE_Entry' WHEN 1 THEN 'Vulnerability' ELSE 'Exploit_Code' END
    WHEN 2 THEN CASE o%4 WHEN 0 THEN 'Subdomain' WHEN 1 THEN 'DNS_Record' WHEN 2 THEN 'Zone_Transfer' ELSE 'Wildcard_Entry' END
    WHEN 3 THEN CASE o%5 WHEN 0 THEN 'API_Key' WHEN 1 THEN 'Password' WHEN 2 THEN 'Config' WHEN 3 THEN 'Source_Code' ELSE 'Secret_Token' END
    ELSE CASE o%4 WHEN 0 THEN 'Data_Dump' WHEN 1 THEN 'Credential_Leak' WHEN 2 THEN 'Config_Dump' ELSE 'PII_Leak' END
  END AS artifact_type""",
    "CONCAT('d', LPAD(CAST(s%25 AS STRING), 2, '0')) AS domain",
    "1+(o*7+n)%30 AS subdomain_count",
    "1+(o*13+p)%900 AS subdomain_age_days",
    "CAST((p*11+s*5)%1001 AS DOUBLE)/1000 AS domain_reputation_score",
    "CAST((p*7+o*3+n)%101 AS DOUBLE)/10 AS cvss_base_score",
    "CASE WHEN (o+p)%4=0 THEN 1 ELSE 0 END AS exploit_availability",
    "CASE WHEN (o+p)%4<>0 THEN 'None' WHEN (o+n)%3=0 THEN 'POC' WHEN (o+n)%3=1 "
    "THEN 'Functional' ELSE 'Weaponized' END AS exploit_maturity",
    "1+(o*17+s)%1500 AS cve_age_days",
    "1+q%15 AS exposure_frequency",
    "CASE (o+2*s)%4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' "
    "ELSE 'Critical' END AS leak_severity",
    "CASE WHEN (p+n)%3=0 THEN 1 ELSE 0 END AS has_credentials",
    "CASE WHEN o%83=0 THEN 60 ELSE (o*5+s)%12 END AS paste_site_mentions",
    "CASE WHEN o%12=0 THEN 1 ELSE 0 END AS ct_log_anomaly",
    "(o*19+p)%400-30 AS ssl_days_remaining",
    "CASE WHEN o%89=0 THEN 150 ELSE (s*3+n)%20 END AS open_ports_count",
    "CASE WHEN (s+n)%3=0 THEN 1 ELSE 0 END AS service_version_outdated",
    "1+(o+p)%15 AS dns_record_type_count",
    "CASE WHEN o%9=0 THEN 1 ELSE 0 END AS is_wildcard_dns",
    "(p+q)%8 AS github_leak_count",
    "CAST((q*13+o)%400 AS DOUBLE)/40 AS exposure_velocity",
    "o AS _o",
]

# Gap injection: which column is emptied for which residue of o mod 97.
GAP_COLUMNS = [
    "subdomain_age_days", "domain_reputation_score", "cvss_base_score",
    "exploit_maturity", "cve_age_days", "leak_severity", "paste_site_mentions",
    "ssl_days_remaining", "open_ports_count", "exposure_velocity",
]
EVENT_COLUMNS = [e.rsplit(" AS ", 1)[1].strip() for e in _EVENT]


def exposure_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exposure event per lineitem row (no label, no gaps)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.selectExpr(*_KEYS).selectExpr(*_EVENT)


def exposure_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean events plus ``risk_score`` (rule-based label, no noise)."""
    return risk_score(exposure_clean(spark, sf_dir), keep_raw=False)


def with_gaps(labeled: DataFrame) -> DataFrame:
    """Empty one column for each residue 0..9 of ``_o % 97`` (labels kept)."""
    r = F.col("_o") % 97
    cols = []
    for c in labeled.columns:
        if c in GAP_COLUMNS:
            cols.append(F.when(r == GAP_COLUMNS.index(c), None).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return labeled.select(*cols)


def exposure_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled events with gaps, plus a full-row copy of every row with _o % 101 = 0."""
    n = with_gaps(exposure_labeled(spark, sf_dir))
    return n.unionByName(n.filter(F.col("_o") % 101 == 0))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What-if scenarios, one per lineitem row: leak level 0..10 in steps of 0.5,
    CVSS 0..10 and a source named as users type it ('Paste Site', 'CT Logs')."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.selectExpr(*_KEYS).selectExpr(
        _EVENT[0],
        "CAST(q % 21 AS DOUBLE) / 2 AS leak",
        "CAST((p*7+o*3+n)%101 AS DOUBLE)/10 AS cvss",
        "CASE p%5 WHEN 0 THEN 'CT Logs' WHEN 1 THEN 'CVE' WHEN 2 THEN 'DNS' "
        "WHEN 3 THEN 'GitHub' ELSE 'Paste Site' END AS source_type",
    )
