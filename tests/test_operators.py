"""Operator unit tests on small hand-made tables with hand-computed results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from exposcope.operators import clean, encode, eda, explain, metrics, outliers, profile, risk
from exposcope.operators import timeseries as ts


def test_impute_median_even_count_and_mode_tie(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b"), (2, 2.0, "a"), (3, None, "b"), (4, 4.0, "a"), (5, 10.0, None)],
        "id int, x double, c string")
    out = clean.impute_mode(clean.impute_median(df, ["x"]), ["c"])
    got = {r["id"]: (r["x"], r["c"]) for r in out.collect()}
    assert got[3][0] == 3.0            # median of 1, 2, 4, 10
    assert got[5][1] == "a"            # tie a/b -> smallest


def test_impute_discovers_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, 7, "x")],
                               "id int, n int, s string")
    out = clean.impute_mode(clean.impute_median(df))
    assert out.filter(F.col("n").isNull() | F.col("s").isNull()).count() == 0
    clean.assert_complete(out)
    with pytest.raises(clean.IncompleteDataError):
        clean.assert_complete(df)


def test_dedupe_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (2, None)], "a int, b int")
    assert clean.dedupe(df).count() == 3
    assert clean.count_duplicates(df).first()[0] == 1
    assert clean.dedupe(clean.dedupe(df)).count() == 3


def test_forward_fill_two_level_matches_window_with_hot_key(spark):
    rows = []
    for i in range(400):
        key = "hot" if i % 3 else f"k{i % 5}"
        val = None if i % 4 else float(i)
        rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), i, val))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id int, v double")
    plain = clean.forward_fill(df, "v", ["t", "id"], ["k"], out="f")
    two = clean.forward_fill(df, "v", ["t", "id"], ["k"], bucket=F.to_date("t"), out="f")
    a = {r["id"]: r["f"] for r in plain.collect()}
    b = {r["id"]: r["f"] for r in two.collect()}
    assert a == b


@pytest.mark.parametrize("seed", range(4))
def test_forward_fill_equals_a_plain_loop(spark, seed):
    """Hot and null keys, keys over many partitions, long stretches without any value, all types."""
    import random
    r = random.Random(seed)
    gap = [0.3, 0.9, 0.99, 1.0][seed]
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i // 3, i, None if r.random() < gap else f"v{i}", i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string, __open int").repartition(6)
    for keys in (["k"], ["k", "__open"], []):
        last, want = {}, {}
        for k, _, i, v, o in rows:
            g = tuple({"k": k, "__open": o}[c] for c in keys)
            last[g] = v if v is not None else last.get(g)
            want[i] = last[g]
        got = clean.forward_fill(df.drop("__open") if "__open" not in keys else df.withColumnRenamed("__open", "__open_"), "v", ["t", "id"],
                                 [c.replace("__open", "__open_") for c in keys], out="f")
        assert {x["id"]: x["f"] for x in got.collect()} == want
        assert [x["v"] for x in got.orderBy("id").collect()] == [x[3] for x in rows]


def test_forward_fill_spreads_one_key(spark):
    """A key with all rows is filled by as many tasks as there are partitions, on the same column too."""
    df = spark.range(4000).select(F.when(F.col("id") % 700 == 5, F.col("id")).alias("v"), F.col("id").alias("t"), F.lit(1).alias("k"))
    got = clean.forward_fill(df, "v", ["t"], ["k"])
    assert got.columns == ["v", "t", "k"]
    assert all(r["v"] == (None if r["t"] < 5 else (r["t"] - 5) // 700 * 700 + 5) for r in got.collect())
    assert got.select(F.spark_partition_id()).distinct().count() >= 4 or got.rdd.getNumPartitions() >= 4
    assert clean.forward_fill(df.where("false"), "v", ["t"], ["k"]).count() == 0


def test_cleaning_fills_times_and_raises_on_what_is_left(spark):
    from exposcope.operators.prepare import clean_events
    rows = [(i, None if i % 3 == 1 else dt.datetime(2024, 1, 1 + i), float(i), "x" if i else None) for i in range(9)]
    df = spark.createDataFrame(rows, "_o int, ts timestamp_ntz, a double, s string")
    got = {r["_o"]: r["ts"] for r in clean_events(df).collect()}
    assert all(got[i] == dt.datetime(2024, 1, 1 + (i - 1 if i % 3 == 1 else i)) for i in range(9))
    with pytest.raises(clean.IncompleteDataError):
        clean_events(df.withColumn("ts", F.when(F.col("_o") > 0, F.col("ts"))))  # nothing before the first row
    with pytest.raises(clean.IncompleteDataError):
        clean_events(df.withColumn("b", F.when(F.col("_o") > 2, F.current_date())))


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-5,), (10,), (500,), (None,)], "x int")
    got = [r[0] for r in clean.clamp(df, "x", 0, 365).collect()]
    assert got == [0, 10, 365, None]


def test_encoding_unknown_null_and_odd_names(spark):
    df = spark.createDataFrame([("Low", None, ".env_File"), ("Severe", "DNS", "Config")],
                               "leak_severity string, source_type string, artifact_type string")
    e = encode.encode_severity(df)
    assert [r["leak_severity_encoded"] for r in e.collect()] == [0, None]
    oh = encode.one_hot(df, "source_type", "source", ["CVE", "DNS"])
    r0, r1 = oh.collect()
    assert (r0["source_CVE"], r0["source_DNS"]) == (0, 0)
    assert (r1["source_CVE"], r1["source_DNS"]) == (0, 1)
    art = encode.one_hot(df, "artifact_type", "artifact")
    assert "artifact__env_File" in art.columns


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    m = encode.fit_scaler(df, ["x", "c"])
    assert m.stds["x"] == pytest.approx(math.sqrt(2.0 / 3.0))
    out = m.transform(df).collect()
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]
    assert out[0]["x"] == pytest.approx(-1.0 / math.sqrt(2.0 / 3.0))


def test_iqr_fence_is_strict(spark):
    # q1 = 2.25, q3 = 4.75 (linear interpolation), upper fence 8.5: 7 is inside.
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (7.0,)], "x double")
    f = outliers.fit_fences(df, ["x"])
    assert f.stats["x"]["q1"] == 2.25 and f.stats["x"]["q3"] == 4.75
    flagged = outliers.flag_outliers(df, ["x"], fences=f).filter("is_outlier = 1").count()
    assert flagged == 0
    df2 = spark.createDataFrame([(2.0,), (2.0,), (4.0,), (4.0,), (7.0,), (7.01,)], "x double")
    f2 = outliers.fit_fences(df2, ["x"])
    upper = f2.stats["x"]["upper"]
    n = outliers.flag_outliers(df2, ["x"], fences=f2).filter("is_outlier = 1").count()
    assert n == sum(1 for v in [2, 2, 4, 4, 7, 7.01] if v > upper)


def test_daily_rolling_with_gap_and_min_periods(spark):
    days = [1, 2, 3, 4, 6, 7, 8, 9]   # day 5 missing: windows count rows, not days
    rows = [(dt.datetime(2025, 1, d, 10), float(d % 3)) for d in days]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, risk_score double")
    d = ts.rolling_std(ts.rolling_mean(ts.daily_risk(df), 7), 30, 7).orderBy("date").collect()
    assert [r["rolling_std"] is None for r in d] == [True] * 6 + [False] * 2
    vals = [float(x % 3) for x in days]
    assert d[7]["rolling_7d"] == pytest.approx(sum(vals[1:8]) / 7)


def test_ewma_matches_recursion(spark):
    rows = [(dt.datetime(2025, 1, i + 1), float(x)) for i, x in enumerate([1, 2, 3, 4, 10])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, risk_score double")
    got = [r["ewma_14d"] for r in ts.ewma(ts.daily_risk(df)).orderBy("date").collect()]
    assert got == pytest.approx([1, 1.133333, 1.382222, 1.731259, 2.833758], abs=1e-6)


def test_ewma_long_series_equals_full_recursion(spark):
    xs = [((i * 37) % 11) / 3.0 for i in range(700)]
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, risk_score double")
    got = [r["ewma_14d"] for r in ts.ewma(ts.daily_risk(df)).orderBy("date").collect()]
    a, y = 2 / 15, xs[0]
    want = [y]
    for x in xs[1:]:
        y = (1 - a) * y + a * x
        want.append(y)
    assert got == pytest.approx(want, abs=1e-12)


def test_metrics_never_predicted_class_has_zero_precision(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2), (1, 2)], "label int, prediction int")
    pc = {r["class"]: r for r in metrics.per_class(df).collect()}
    assert pc[1]["precision"] == 0.0 and pc[1]["recall"] == 0.0 and pc[1]["f1"] == 0.0
    m = metrics.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(3 / 5)
    cm = {r["label"]: r for r in metrics.confusion_matrix(df).collect()}
    assert cm[1]["pred_0"] == 1 and cm[1]["pred_2"] == 1 and cm[1]["pred_1"] == 0


def test_roc_with_tied_scores(spark):
    rows = [(1, 0.9, 0.1), (0, 0.9, 0.1), (1, 0.5, 0.5), (0, 0.2, 0.8)]
    df = spark.createDataFrame(rows, "label int, prob_1 double, prob_0 double")
    pts = metrics.roc_points(df, "label", ["prob_0", "prob_1"])
    auc = {r["class"]: r["auc"] for r in metrics.roc_auc(pts).collect()}
    # class 1: pos {0.9, 0.5}, neg {0.9, 0.2}: pairs win 2, tie 1 of 4 -> 2.5 / 4
    assert auc[1] == pytest.approx(0.625)


def test_insights_levels_and_ssl(spark):
    rows = [(4, 9.0, 0.8, 3, 1, 6.0, 4, -5.0, 3.5, 0.9), (3, 6.5, 0.1, 2, 0, 0.0, 0, 10.0, 0.0, 0.75),
            (2, 1.0, 0.1, 0, 0, 0.0, 0, 200.0, 0.0, 0.75), (1, 1.0, 0.1, 0, 0, 0.0, 0, 200.0, 0.0, 0.75),
            (0, 1.0, 0.1, 0, 0, 0.0, 0, 200.0, 0.0, 0.75)]
    df = spark.createDataFrame(rows, "predicted_risk int, cvss_base_score double, anomaly_score double, "
                               "leak_severity_encoded int, has_credentials int, paste_site_mentions double, "
                               "github_leak_count int, ssl_days_remaining double, "
                               "exposure_velocity double, confidence double")
    out = explain.insights(df).orderBy(F.col("predicted_risk").desc()).collect()
    assert "90%" in out[0]["headline"]
    assert out[0]["factors"].startswith("base score 9.0 of 10 is in the top band, unlike the other events (score 0.80)")
    assert "ran out 5 days back" in out[0]["factors"]
    assert "has 10 days left" in out[1]["factors"]
    assert out[2]["factors"] is None and "Reasons" not in out[2]["insight"]
    assert len({r["recommendation"] for r in out}) == 4


def test_patterns_at_boundaries(spark):
    rows = [(100, 2.0, 0, "None", 0, 0.5, 100, 400), (0, 3.0, 1, "Weaponized", 0, 0.5, 100, 400),
            (0, 5.0, 0, "None", 50, 0.15, 100, 400), (0, 5.0, 0, "None", 0, 0.85, -1, 400),
            (0, 9.0, 1, "Weaponized", 0, 0.5, 100, 7), (100, 1.0, 1, "Weaponized", 0, 0.5, 100, 400)]
    df = spark.createDataFrame(rows, "open_ports_count int, cvss_base_score double, "
                               "exploit_availability int, exploit_maturity string, "
                               "paste_site_mentions int, domain_reputation_score double, "
                               "ssl_days_remaining int, cve_age_days int")
    got = [r["patterns"] for r in risk.tag_patterns(df).collect()]
    assert got[:5] == [[n] for n in risk.PATTERN_NAMES]
    assert got[5] == ["high_port_low_cvss", "weaponized_low_cvss"]


def test_breakdown_terms_sum_to_raw(spark, sf_small):
    from exposcope.sources.standin import exposure_clean
    b = risk.risk_breakdown(exposure_clean(spark, sf_small), ["event_id"])
    bad = (b.groupBy("event_id", "risk_raw").agg(F.sum("contribution").alias("s"))
           .filter(F.abs(F.col("s") - F.col("risk_raw")) > 1e-9).count())
    assert bad == 0


def test_one_hot_rows_sum_to_one(spark, sf_small):
    from exposcope.sources.standin import exposure_clean
    d = encode.one_hot_source(exposure_clean(spark, sf_small))
    s = sum(F.col(f"source_{v}") for v in ["CT_Log", "CVE", "DNS", "GitHub", "Paste"])
    assert d.filter(s != 1).count() == 0


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 2.0), (0, 4.0)], "g int, x double")
    h = {r["bin"]: r["count"] for r in eda.histogram_by(df, "x", ["g"], bins=4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 1}


def test_kde_integrates_to_about_one(spark):
    rows = [(0, float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, x double")
    d = eda.density_by(df, "x", ["g"], grid=200).orderBy("i").collect()
    step = d[1]["x"] - d[0]["x"]
    assert sum(r["density"] for r in d) * step == pytest.approx(1.0, abs=0.02)


def test_preview_and_summary(spark):
    df = spark.createDataFrame([(3, dt.datetime(2025, 1, 3)), (1, dt.datetime(2025, 1, 1))],
                               "id int, ts timestamp_ntz")
    assert [r["id"] for r in profile.preview(df, 1, ["ts"]).collect()] == [1]
    s = profile.dataset_summary(df).first()
    assert s["rows"] == 2 and s["columns"] == 2


def test_mode_numeric_tie_breaks_on_number(spark):
    df = spark.createDataFrame([(9,), (9,), (10,), (10,), (3,)], "x int")
    assert clean.fit_modes(df, ["x"]) == {"x": 9}
    df2 = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string")
    assert clean.fit_modes(df2, ["s"]) == {"s": "a"}


def test_label_codes_distributed_rank(spark):
    vals = [f"d{(i * 7919) % 5003:05d}" for i in range(20000)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "domain string")
    codes = {r["domain"]: r["domain_encoded"]
             for r in encode.label_codes(df, "domain").collect()}
    want = {v: i for i, v in enumerate(sorted(set(vals)))}
    assert codes == want


def test_binned_density_stays_within_its_bound(spark):
    """Against the exact kernel sum; null groups, nulls, a group without spread."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=800)] + [(None, float(v)) for v in rng.exponential(size=500)] + [("one", 1.0)] * 5 + [("a", None)]
    df = spark.createDataFrame(rows, "risk_score string, x double")
    exact = {(r["risk_score"], r["i"]): (r["x"], r["density"]) for r in eda.density_by(df, "x").collect()}
    for bins in (64, 1024):
        got = {(r["risk_score"], r["i"]): (r["x"], r["density"]) for r in eda.binned_density(df, "x", bins=bins).collect()}
        assert set(got) == set(exact) and {k[0] for k in got} == {"a", None}
        for g in ("a", None):
            v = np.array([x for k, x in rows if k == g and x is not None])
            h = v.std(ddof=1) * len(v) ** -0.2
            d = (v.max() - v.min()) / (bins - 1)
            for i in range(100):
                assert got[g, i][0] == pytest.approx(exact[g, i][0], abs=1e-9)
                assert abs(got[g, i][1] - exact[g, i][1]) <= d * d / (8 * h * h) * 0.4 / h + 1e-12
    q = {r["risk_score"]: (r["q1"], r["median"], r["q3"]) for r in eda.violin(df, "x").collect()}
    assert q["a"] == pytest.approx(tuple(np.quantile([x for k, x in rows if k == "a" and x is not None], [0.25, 0.5, 0.75])))


def test_long_forms_carry_constant_names(spark):
    """One row per entry, names as ``display_name`` and the terms give them, null values kept."""
    from exposcope.operators import explain
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, 4)], "event_id string, cvss_base_score double, open_ports_count int")
    got = explain.features_long(df, ["event_id"], ["cvss_base_score", "open_ports_count"])
    assert got.columns == ["event_id", "feature", "value", "display_name"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("a", "cvss_base_score", 1.5, "Cvss Base Score"), ("a", "open_ports_count", None, "Open Ports Count"),
        ("b", "cvss_base_score", None, "Cvss Base Score"), ("b", "open_ports_count", 4.0, "Open Ports Count")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" not in plan


def test_rows_are_not_combined_before_the_dedupe_shuffle(spark):
    """One shuffle of whole rows, no hash table of rows before it; nulls and copies count as before."""
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (None, None)], "a int, b string")
    assert clean.count_duplicates(df).first()[0] == 3
    out = clean.dedupe(df)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (2, "x"), (None, None)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange" if "Exchange" in plan else "RepartitionByExpression")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]


def test_left_nulls_are_told_with_all_copies(spark):
    from exposcope.operators.prepare import clean_events
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    with pytest.raises(clean.IncompleteDataError, match="'b': 2"):
        clean_events(df, [], [])


@pytest.mark.parametrize("bits", [27, 10])
def test_only_rows_that_may_have_copies_are_shuffled(spark, monkeypatch, bits):
    # with few places most rows share one, and must still be compared in full
    monkeypatch.setattr(clean, "PLACE_BITS", bits)
    rows = [(i, f"t{i % 7}" if i % 5 else None, None if i % 11 == 0 else i / 4) for i in range(3000)]
    odd = [(-1, "a", 0.0), (-1, "a", -0.0), (-2, None, float("nan")), (-2, None, float("nan")), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows + rows[::100] + rows[:1] * 50 + odd, "a long, b string, c double").repartition(3)
    every, kept = clean.written_dedupe(df)
    assert every.columns == kept.columns == df.columns
    assert every.count() == len(rows) + 30 + 50 + 6
    want = df.dropDuplicates()
    assert kept.count() == want.count() == len(rows) + 3
    assert kept.exceptAll(want).count() == 0
    assert clean.count_duplicates(df).first()[0] == 30 + 50 + 3
    if bits == 27:  # whole rows moved: copies and what shares a place with them
        d = df.withColumn("__h", clean._digest(df))
        assert clean._with_repeats(d, clean._places_of_repeats(d.select("__h")), True).count() < 200


def test_no_copies_no_rows(spark):
    df = spark.range(100).selectExpr("id", "cast(null as string) AS s")
    assert clean.count_duplicates(df).first()[0] == 0 and clean.count_duplicates(df.limit(0)).first()[0] == 0
    assert clean.written_dedupe(df)[1].count() == 100 and clean.written_dedupe(df.limit(0))[1].count() == 0
