"""What the cleaning chain and the queries behind it cost: passes, generated code, values kept."""

import re

import pytest
from pyspark.sql import functions as F

from exposcope.functions.columns import fixed, rounded
from exposcope.operators import clean, quantiles
from exposcope.operators.explain import insights
from exposcope.operators.quantiles import exact_quantiles


def _largest_method(df, capsys):
    df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_quantiles_of_few_values_take_two_passes(spark, monkeypatch):
    """The range is no pass of its own: buckets of powers of two hold a thousand values each."""
    passes = []
    monkeypatch.setattr(quantiles, "_count", lambda *a, f=quantiles._count: (passes.append(1), f(*a))[1])
    df = spark.range(20_020).select((F.col("id") * 8 % 1001 / 1000).alias("x"))
    monkeypatch.setattr(type(df), "agg", lambda *a: pytest.fail("a pass for the range"))
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [0.5]
    assert len(passes) == 2


def test_any_null_sees_every_column(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ '2024-01-01 00:00:00', 1.5D) t(i, s, t, d)")
    assert not clean.any_null(df, df.columns)
    assert not clean.any_null(df, [])
    for c in df.columns:
        some = df.unionByName(df.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])))
        assert clean.any_null(some, df.columns), c
        assert not clean.any_null(some, [x for x in df.columns if x != c]), c


def test_rounded_is_round(spark):
    values = [k * 5e-7 for k in range(-400, 400)] + [k / 7 for k in range(-400, 400)] + [
        None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e9 + 0.123456789, 1e300, -1e-9, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        F.round("x", 6).alias("want"), rounded("x", 6).alias("got")).collect()
    for r in rows:
        assert repr(r["want"]) == repr(r["got"])


def test_fixed_as_printed(spark):
    values = [k / 8 for k in range(-100, 100)] + [k / 1000 for k in range(-1500, 1500)] + [2.5e-9, 0.0, 123456789.05]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", *[fixed("x", d).alias(f"t{d}") for d in range(3)]).collect():
        for d in range(3):
            want = f"{abs(r['x']):.{d}f}"
            assert r[f"t{d}"] == ("-" + want if r["x"] < 0 else want)
    assert spark.createDataFrame([(None,)], "x double").select(fixed("x", 2)).first()[0] == "null.null"  # as before


def test_insight_code_is_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes."""
    df = spark.range(10).selectExpr(
        "id AS event_id", "CAST(id % 5 AS INT) AS predicted_risk", "id / 10D AS anomaly_score", "id / 9D AS confidence",
        "CAST(id AS DOUBLE) AS cvss_base_score", "CAST(id % 4 AS INT) AS leak_severity_encoded", "id AS paste_site_mentions",
        "id AS github_leak_count", "id AS ssl_days_remaining", "id / 2D AS exposure_velocity", "1 AS has_credentials")
    assert _largest_method(insights(df), capsys) < 8000


def test_model_table_is_spread(spark, tmp_path):
    """Rows of an input of one row group are scored in many tasks, about as many in each."""
    from exposcope.plans.ml_queries import model_table
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(2000)
    source.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    files = model_table(spark, str(tmp_path)).groupBy(F.input_file_name()).count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(files) == parts and max(r["count"] for r in files) < 2 * 2000 / parts + 10


def test_rows_of_many_row_groups_are_not_shuffled(spark):
    """Tables that many tasks read already stay where they are; others are dealt anew."""
    from exposcope.plans.ml_queries import spread
    cores, parts = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = spark.range(0, 4000, 1, 2 * cores)
    assert spread(even) is even and spread(even.where("false")).count() == 0
    uneven = even.unionByName(spark.range(4000, 14000, 1, 1))
    assert spread(uneven).rdd.getNumPartitions() == parts and spread(uneven).count() == 14000
