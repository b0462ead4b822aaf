"""Shared DuckDB oracle text: the stand-in event views as CTEs.

The oracle for each registered query is plain SQL written independently of
the DataFrame code; only the stand-in mapping (the fixture) is shared.
"""

from __future__ import annotations

from exposcope.sources.standin import _EVENT, _KEYS, GAP_COLUMNS

CLEAN_CTE = (
    "k AS (SELECT " + ", ".join(_KEYS) + " FROM lineitem),\n"
    "clean AS (SELECT " + ",\n  ".join(_EVENT) + "\nFROM k)"
)

RAW_SQL = """(cvss_base_score/10e0*3e0
 + CASE WHEN exploit_availability=1 THEN 1.5e0 ELSE 0e0 END
 + CASE WHEN exploit_availability=1 THEN (CASE exploit_maturity WHEN 'Weaponized' THEN 2e0
     WHEN 'Functional' THEN 1e0 WHEN 'POC' THEN 0.5e0 ELSE 0e0 END) ELSE 0e0 END
 + CASE WHEN has_credentials=1 THEN 1.5e0 ELSE 0e0 END
 + CASE leak_severity WHEN 'Low' THEN 0.2e0 WHEN 'Medium' THEN 0.6e0 WHEN 'High' THEN 1.2e0
     WHEN 'Critical' THEN 2e0 ELSE 0e0 END
 + (1e0-domain_reputation_score)*1.5e0
 + least(1.5e0, exposure_frequency/10e0)
 + least(1e0, exposure_velocity/8e0)
 + CASE WHEN ct_log_anomaly=1 THEN 0.8e0 ELSE 0e0 END
 + CASE WHEN ssl_days_remaining<=0 THEN 1e0 WHEN ssl_days_remaining<=30 THEN 0.5e0 ELSE 0e0 END
 + CASE WHEN service_version_outdated=1 THEN 0.6e0 ELSE 0e0 END
 + least(0.8e0, open_ports_count/50e0)
 + least(0.8e0, github_leak_count/10e0)
 + least(0.6e0, paste_site_mentions/15e0)
 + CASE WHEN cve_age_days>365 THEN 0.5e0 WHEN cve_age_days>180 THEN 0.3e0 ELSE 0e0 END)"""


def level_sql(x: str) -> str:
    return (f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN {x}<3.5e0 THEN 0 WHEN {x}<6e0 THEN 1 "
            f"WHEN {x}<8.5e0 THEN 2 WHEN {x}<11e0 THEN 3 ELSE 4 END AS INTEGER)")


LABELED_CTE = (
    "scored AS (SELECT *, " + RAW_SQL + " AS risk_raw FROM clean),\n"
    "labeled AS (SELECT * EXCLUDE (risk_raw), " + level_sql("risk_raw") + " AS risk_score FROM scored)"
)

_gap_cols = []
for _c in ["event_id", "ts", "source_type", "artifact_type", "domain", "subdomain_count",
           "subdomain_age_days", "domain_reputation_score", "cvss_base_score",
           "exploit_availability", "exploit_maturity", "cve_age_days", "exposure_frequency",
           "leak_severity", "has_credentials", "paste_site_mentions", "ct_log_anomaly",
           "ssl_days_remaining", "open_ports_count", "service_version_outdated",
           "dns_record_type_count", "is_wildcard_dns", "github_leak_count",
           "exposure_velocity", "_o", "risk_score"]:
    if _c in GAP_COLUMNS:
        _gap_cols.append(f"CASE WHEN _o%97={GAP_COLUMNS.index(_c)} THEN NULL ELSE {_c} END AS {_c}")
    else:
        _gap_cols.append(_c)

RAW_CTE = (
    "n AS (SELECT " + ", ".join(_gap_cols) + " FROM labeled),\n"
    "raw AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE _o%101=0)"
)


def with_ctes(body: str, *, labeled: bool = True, raw: bool = False, extra: str = "") -> str:
    parts = [CLEAN_CTE]
    if labeled or raw:
        parts.append(LABELED_CTE)
    if raw:
        parts.append(RAW_CTE)
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body
