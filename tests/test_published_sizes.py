"""The registered training queries train models of the published sizes, and evaluate them as said."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from exposcope.operators import models, trees
from exposcope.plans import ml_queries


class Asked(Exception):
    """Carries the parameters that a query was about to train with."""


@pytest.mark.parametrize("name,kind", [("g6_random_forest", "rf"), ("g7_boosted_trees", "gbt"), ("g8_cv_forest", "rf"), ("g8_cv_boosted", "gbt"),
                                       ("g14_feature_importances", "rf"), ("f7_predict_models", "rf"), ("a4_model_roundtrip", "rf"),
                                       ("l1_model_stream", "rf"), ("g9_forest_metrics", "rf"), ("f9_forest_explain", "rf")])
def test_training_queries_train_the_published_sizes(spark, monkeypatch, name, kind):
    def ask(df, cols, label, key, params=None, *folds):
        raise Asked(params or (trees.ForestParams() if kind == "rf" else trees.BoostParams()))

    monkeypatch.setattr(models, "train_forest" if kind == "rf" else "train_boosted", ask)
    t = spark.createDataFrame([(1, 0, 1, 0)], "event_id long, is_test int, risk_score int, fold int")
    monkeypatch.setattr(ml_queries, "training_frame", lambda *_: (t, t, None, None))
    monkeypatch.setattr(ml_queries, "_TRAINED", {})
    with pytest.raises(Asked) as asked:
        E.queries()[name](spark, "unused")
    p = asked.value.args[0]
    if kind == "rf":
        assert (p.num_trees, p.max_depth, p.min_samples_split, p.min_samples_leaf, p.balanced) == (300, 20, 5, 2, True)
    else:
        assert (p.rounds, p.max_depth, p.rate, p.row_share, p.column_share, p.l1, p.l2) == (300, 10, 0.1, 0.8, 0.8, 0.1, 1.0)


def test_forest_evaluation_equals_plain_counts(spark, sf_small):
    """G9 to G12 on the trained forest's hold-out rows, recomputed from the rows."""
    rows = ml_queries._predicted(spark, sf_small, "rf").select("label", "predicted_risk", *[f"prob_{k}" for k in range(5)]).collect()
    y, p = (np.array([r[k] for r in rows]) for k in ("label", "predicted_risk"))
    got = E.queries()["g9_forest_metrics"](spark, sf_small).first()
    assert got["accuracy"] == pytest.approx((y == p).mean()) and got["accuracy"] > 0.6
    report = {r["row"]: r for r in E.queries()["g10_forest_report"](spark, sf_small).collect()}
    matrix = {r["label"]: [r[f"pred_{k}"] for k in range(5)] for r in E.queries()["g11_forest_confusion"](spark, sf_small).collect()}
    from exposcope.schema import RISK_LABELS
    for k in sorted(set(y)):
        assert matrix[k] == [int(((y == k) & (p == j)).sum()) for j in range(5)]
        row = report[RISK_LABELS[k]]
        assert row["support"] == (y == k).sum() and row["recall"] == pytest.approx((p[y == k] == k).mean())
        assert row["precision"] == pytest.approx((y[p == k] == k).mean() if (p == k).any() else 0)
    for r in E.queries()["g12_forest_auc"](spark, sf_small).collect():
        s = np.array([q[f"prob_{r['class']}"] for q in rows])
        a, b = s[y == r["class"]], s[y != r["class"]]
        if len(a) and len(b):
            assert r["auc"] == pytest.approx((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean(), abs=1e-9)


def test_model_comparison(spark, sf_small, monkeypatch):
    """G13 over both trained models with their cross-validation (fewer rounds here; sizes are tested above)."""
    monkeypatch.setattr(models, "BoostParams", lambda: trees.BoostParams(rounds=12, max_depth=4))
    monkeypatch.setattr(models, "ForestParams", lambda: trees.ForestParams(num_trees=20))
    monkeypatch.setattr(ml_queries, "_TRAINED", {k: v for k, v in ml_queries._TRAINED.items() if k[2] == "frame"})
    t = E.queries()["g13_trained_models"](spark, sf_small)
    rows = {r["model"]: r for r in t.collect()}
    assert set(rows) == {"Random Forest", "Boosted Trees"} and sum(r["is_best"] for r in rows.values()) == 1
    best = max(rows.values(), key=lambda r: r["accuracy"])
    for r in rows.values():
        assert abs(r["cv_accuracy"] - r["accuracy"]) < 0.1 and 0 <= r["cv_std"] < 0.1 and (r["is_best"] == 1) == (r["accuracy"] == best["accuracy"])
    assert t.select(F.max("cv_accuracy")).first()[0] > 0.6
