import __spark_entry__ as E
from exposcope.plans import QUERIES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2289
    assert set(df.columns) >= {"date", "mean_risk", "rolling_7d", "rolling_30d", "ewma_14d",
                               "spike_threshold", "is_spike"}
    assert sum(r["is_spike"] for r in rows) == 62


def test_registry_names():
    qs = E.queries()
    assert len(qs) >= 80
    assert not any(n.startswith("op") for n in QUERIES)
