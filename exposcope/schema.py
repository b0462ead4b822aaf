"""Schema of exposure events and the fixed values the operators depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the published pipeline for equal results):
# label names, category orders, weights and feature lists.
# --------------------------------------------------------------------------
RISK_LABELS = ["Low", "Medium", "High", "Critical", "Emergency"]
SEVERITY_ORDER = ["Low", "Medium", "High", "Critical"]
MATURITY_ORDER = ["None", "POC", "Functional", "Weaponized"]
SOURCE_TYPES = ["CT_Log", "CVE", "DNS", "GitHub", "Paste"]
ARTIFACT_TYPES = [
    "API_Key", "CVE_Entry", "Cert_Anomaly", "Certificate", "Config",
    "Config_Dump", "Credential_Leak", "DNS_Record", "Data_Dump",
    "Exploit_Code", "PII_Leak", "Password", "Secret_Token", "Source_Code",
    "Subdomain", "Vulnerability", "Wildcard_Cert", "Wildcard_Entry",
    "Zone_Transfer",
]
# Rule-score weights per leak severity and exploit maturity bonus.
SEVERITY_WEIGHT = {"Low": 0.2, "Medium": 0.6, "High": 1.2, "Critical": 2.0}
MATURITY_BONUS = {"Weaponized": 2.0, "Functional": 1.0, "POC": 0.5}
# Raw-score cut points between the five risk levels.
RISK_CUTS = [3.5, 6.0, 8.5, 11.0]
# Scenario source names as typed by users, mapped to stored names.
SOURCE_ALIAS = {"GitHub": "GitHub", "DNS": "DNS", "CVE": "CVE",
                "Paste Site": "Paste", "CT Logs": "CT_Log"}
# First artifact offered per scenario source.
SCENARIO_ARTIFACT = {"GitHub": "Password", "CVE": "CVE_Entry", "DNS": "Subdomain",
                     "Paste Site": "Credential_Leak", "CT Logs": "Certificate"}

BASE_FEATURES = [
    "subdomain_count", "subdomain_age_days", "domain_reputation_score",
    "cvss_base_score", "exploit_availability", "cve_age_days",
    "exposure_frequency", "has_credentials", "paste_site_mentions",
    "ct_log_anomaly", "ssl_days_remaining", "open_ports_count",
    "service_version_outdated", "dns_record_type_count", "is_wildcard_dns",
    "github_leak_count", "exposure_velocity",
    "leak_severity_encoded", "exploit_maturity_encoded",
]
SCALE_FEATURES = [
    "subdomain_count", "subdomain_age_days", "domain_reputation_score",
    "cvss_base_score", "cve_age_days", "exposure_frequency",
    "paste_site_mentions", "ssl_days_remaining", "open_ports_count",
    "dns_record_type_count", "github_leak_count", "exposure_velocity",
    "leak_severity_encoded", "exploit_maturity_encoded",
]
OUTLIER_FEATURES = [
    "subdomain_count", "subdomain_age_days", "cvss_base_score",
    "exposure_frequency", "paste_site_mentions", "open_ports_count",
    "github_leak_count", "exposure_velocity", "cve_age_days",
]
CORR_FEATURES = [
    "subdomain_count", "subdomain_age_days", "domain_reputation_score",
    "cvss_base_score", "exploit_availability", "cve_age_days",
    "exposure_frequency", "has_credentials", "paste_site_mentions",
    "ct_log_anomaly", "ssl_days_remaining", "open_ports_count",
    "service_version_outdated", "github_leak_count", "exposure_velocity",
    "anomaly_score", "risk_score",
]
# --------------------------------------------------------------------------

CATEGORICAL = ["source_type", "artifact_type", "domain", "exploit_maturity", "leak_severity"]

ONE_HOT_SOURCE = [f"source_{v}" for v in SOURCE_TYPES]
ONE_HOT_ARTIFACT = [f"artifact_{v}" for v in ARTIFACT_TYPES]
MODEL_FEATURES = BASE_FEATURES + ONE_HOT_SOURCE + ONE_HOT_ARTIFACT
MODEL_FEATURES_WITH_ANOMALY = MODEL_FEATURES + ["anomaly_score"]

EXPOSURE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("artifact_type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("subdomain_count", T.IntegerType()),
    T.StructField("subdomain_age_days", T.IntegerType()),
    T.StructField("domain_reputation_score", T.DoubleType()),
    T.StructField("cvss_base_score", T.DoubleType()),
    T.StructField("exploit_availability", T.IntegerType()),
    T.StructField("exploit_maturity", T.StringType()),
    T.StructField("cve_age_days", T.IntegerType()),
    T.StructField("exposure_frequency", T.IntegerType()),
    T.StructField("leak_severity", T.StringType()),
    T.StructField("has_credentials", T.IntegerType()),
    T.StructField("paste_site_mentions", T.IntegerType()),
    T.StructField("ct_log_anomaly", T.IntegerType()),
    T.StructField("ssl_days_remaining", T.IntegerType()),
    T.StructField("open_ports_count", T.IntegerType()),
    T.StructField("service_version_outdated", T.IntegerType()),
    T.StructField("dns_record_type_count", T.IntegerType()),
    T.StructField("is_wildcard_dns", T.IntegerType()),
    T.StructField("github_leak_count", T.IntegerType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("exposure_velocity", T.DoubleType()),
    T.StructField("risk_score", T.IntegerType()),
])

# The hand-made seed layout: 14 columns, no time and no label.
SEED_COLUMNS = [
    "source_type", "artifact_type", "domain", "cvss_base_score",
    "exploit_availability", "exploit_maturity", "leak_severity",
    "has_credentials", "paste_site_mentions", "open_ports_count",
    "ssl_days_remaining", "domain_reputation_score", "cve_age_days",
    "exposure_frequency",
]
