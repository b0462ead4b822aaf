"""Exact quantiles with bounded memory equal numpy's linear interpolation."""

import numpy as np
import pytest

from exposcope.operators.quantiles import exact_quantiles, grouped_quantiles

PROBS = [0.05, 0.25, 0.5, 0.75]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = []
    # hot group: a third of all rows, heavy duplicates; others continuous / tiny
    rows += [("hot", float(v)) for v in rng.integers(0, 5, size=6000)]
    rows += [("cont", float(v)) for v in rng.normal(10, 3, size=9000)]
    rows += [("tiny", float(v)) for v in [3.0, 1.0, 2.0]]
    rows += [("hot", None)] * 50
    return spark.createDataFrame(rows, "g string, x double"), rows


def _np(rows, g=None):
    return np.array([x for k, x in rows if x is not None and (g is None or k == g)])


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_global(skewed, buckets):
    df, rows = skewed
    got = exact_quantiles(df, ["x"], PROBS, buckets=buckets)["x"]
    assert got == pytest.approx(list(np.quantile(_np(rows), PROBS)), abs=1e-12)


def test_grouped(skewed):
    df, rows = skewed
    out = {r["g"]: r for r in grouped_quantiles(df, ["g"], "x", PROBS).collect()}
    for g in ["hot", "cont", "tiny"]:
        want = np.quantile(_np(rows, g), PROBS)
        assert [out[g][f"q{j}"] for j in range(len(PROBS))] == pytest.approx(list(want), abs=1e-12), g
        assert out[g]["n"] == len(_np(rows, g))


def test_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    vals = [-inf, -1e308, 1e-320, 5e-324, 0.0, 3.0, 1e308, inf, nan, None]
    df = spark.createDataFrame([(v, None) for v in vals], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.0, 2 / 7, 5 / 7, 1.0])
    assert got["x"] == [-inf, 0.0, 3.0, inf] and got["y"] == [None] * 4


def test_many_distinct_values(spark):
    from pyspark.sql import functions as F
    df = spark.range(1_200_000).select((F.pmod(F.col("id") * 7919, F.lit(1_200_000)) / 3.0).alias("x"))
    got = exact_quantiles(df, ["x"], [0.25, 0.5])["x"]
    assert got == pytest.approx([1_199_999 * 0.25 / 3, 1_199_999 * 0.5 / 3], rel=1e-12)


def test_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert {r["g"]: (r["n"], r["q0"]) for r in grouped_quantiles(df, ["g"], "x", [0.5]).collect()} == {None: (2, 2.0), "a": (1, 5.0)}


def test_passes_do_not_depend_on_the_spread(spark, monkeypatch):
    """601 powers of ten, values of both signs, infinities: at most 7 passes with the first one."""
    from exposcope.operators import quantiles
    passes = []
    plain = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: (passes.append(1), plain(*a))[1])
    wide = [10.0 ** k for k in range(-300, 301)]
    near = [1.0 + k * 2.0 ** -52 for k in range(700)]  # neighbouring doubles
    signed = [-v for v in wide] + wide + [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, float("nan")]
    for values in (wide, near, signed):
        passes.clear()
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
        got = exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.77, 1.0])["x"]
        want = sorted(v for v in values if v == v)
        for p, g in zip([0.0, 0.1, 0.5, 0.77, 1.0], got):
            at = p * (len(want) - 1)
            a, b = want[int(at)], want[min(int(at) + 1, len(want) - 1)]
            assert g == (a if at == int(at) else pytest.approx(a + (b - a) * (at - int(at))))
        assert 1 + len(passes) <= 7


def test_keys_sort_as_values():
    from exposcope.operators.quantiles import from_key, to_key
    values = [float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, float("inf")]
    keys = [to_key(v) for v in values]
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and [from_key(k) for k in keys] == values
    assert to_key(-0.0) == to_key(0.0)


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"__extra": {}, "a": [None], "b": [1.5]}
    assert exact_quantiles(df.where("false"), ["a"], [0.5])["a"] == [None]
