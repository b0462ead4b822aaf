"""Cases with nulls, clashing names and large values that the oracle data avoid."""


import pytest
from pyspark.sql import functions as F

from exposcope.functions.columns import fixed
from exposcope.operators import clean, eda, encode, joins, outliers
from exposcope.sources import io


def test_null_groups_keep_their_rows(spark, monkeypatch):
    rows = [(None if i % 4 == 0 else i % 2, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "risk_score int, x double")
    for limit in (joins.MAX_BROADCAST_ROWS, 0):  # 0: the salted join
        monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", limit)
        assert eda.histogram_by(df, "x").agg(F.sum("count")).first()[0] == 40
        box = {r["risk_score"]: r for r in eda.box_stats(df, "x").collect()}
        assert sorted(box, key=str) == [0, 1, None] and sum(r["n"] for r in box.values()) == 40
        assert {r["risk_score"] for r in eda.density_by(df, "x", grid=5).collect()} == {0, 1, None}


def test_forward_fill_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1, 0, "1"), (None, 2, 0, None), (None, 3, 1, None), (None, 4, 1, None)],
                               "k string, t int, b int, v string")
    got = clean.forward_fill(df, "v", ["t"], ["k"], bucket=F.col("b")).orderBy("t").collect()
    assert [r["v"] for r in got] == ["1"] * 4


def test_one_hot_names_that_clash(spark):
    df = spark.createDataFrame([("a-b",), ("a_b",), (None,)], "c string")
    got = encode.one_hot(df, "c")
    assert got.columns == ["c", "c_a_b", "c_a_b_2"]
    assert [tuple(r)[1:] for r in got.collect()] == [(1, 0), (0, 1), (0, 0)]
    assert encode.feature_columns(got.withColumn("c_other", F.lit(1)), base=[]) == ["c_a_b", "c_a_b_2"]


def test_label_codes_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(30_000).select(F.format_string("v%d", F.col("id") * 7919 % 30_011).alias("v"))
        codes = encode.label_codes(df, "v").orderBy("v").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [r["v_encoded"] for r in codes] == list(range(len(codes)))


def test_correlation_of_large_means(spark):
    import numpy as np
    r = np.random.default_rng(2)
    a = r.normal(1e9, 1, 500)
    b = a + r.normal(0, 0.2, 500)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(x["feature_a"], x["feature_b"]): x["r"] for x in eda.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["b", "a"] == pytest.approx(np.corrcoef(a - 1e9, b - 1e9)[0, 1], abs=1e-6)


def test_columns_without_values_have_no_fence(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    f = outliers.fit_fences(df, ["x", "y"])
    assert f.stats["x"]["lower"] is None
    assert [r["is_outlier"] for r in outliers.flag_outliers(df, ["x", "y"], fences=f).collect()] == [0, 0]
    rep = {r["feature"]: r for r in outliers.outlier_report(df, ["x", "y"], only_flagged=False).collect()}
    assert rep["x"]["iqr_outliers"] == 0 and rep["x"]["min"] is None


def test_csv_headers_and_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"source_type","domain","cvss_base_score"\ngithub,"x,y.com",5.5\n')
    (tmp_path / "b.csv").write_text("domain,risk_score\nz.com,3\n")
    rows = io.read_events(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("domain").collect()
    assert [(r["domain"], r["cvss_base_score"], r["risk_score"]) for r in rows] == [("x,y.com", 5.5, None), ("z.com", None, 3)]
    (tmp_path / "c.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError):
        io.read_events(spark, str(tmp_path / "c.csv"))


def test_csv_folder_of_layouts(spark, tmp_path):
    """Files of three layouts in one folder, more files than tasks, one of several splits; bad rows aside."""
    folder = tmp_path / "in"
    folder.mkdir()
    want = set()
    for k in range(60):
        if k % 2:
            (folder / f"f{k:03}.csv").write_text(f'domain,risk_score,cvss_base_score\n"d{k},x",{k % 5},{k}.5\n')
            want.add((f"d{k},x", k % 5, k + 0.5, None))
        else:
            (folder / f"f{k:03}.csv").write_text(f"\ncvss_base_score, domain ,note\n{k}.25,e{k},n{k}\n\ncvss_base_score, domain ,note\n")
            want.add((f"e{k}", None, k + 0.25, f"n{k}"))
    (folder / "empty.csv").write_text("")
    (folder / "long.csv").write_text("risk_score,domain\n" + "".join(f"{i % 5},long{i}\n" for i in range(20000)))
    want |= {(f"long{i}", i % 5, None, None) for i in range(20000)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = io.read_events(spark, str(folder))
        got = [(r["domain"], r["risk_score"], r["cvss_base_score"], r["note"]) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
        (folder / "odd.csv").write_text("risk_score,domain\nx,bad1\n1,ok\n2,too,many\n3\n")
        rows = io.read_events(spark, str(folder), bad="line").where("domain like 'bad%' OR domain = 'ok' OR line IS NOT NULL").collect()
        assert sorted((r["line"] or "", r["domain"]) for r in rows) == [("", "ok"), ("2,too,many", "too"), ("3", None), ("x,bad1", "bad1")]
        with pytest.raises(Exception, match="(?i)malformed"):
            io.read_events(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_number_text_is_exact(spark):
    vals = [3.15, 3.25, 8.25, 0.05, 0.95, 9.95, 2.5, 0.5, 1.5, -1.25, 0.0, 123456.789, 0.145, 0.155, 1.005, 2.675, 1e6 + 0.05]
    vals += [k / 200 for k in range(0, 4000, 7)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for d in (0, 1, 2):
        got = [r[0] for r in df.select(fixed("x", d)).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]


