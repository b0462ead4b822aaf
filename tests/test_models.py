"""Invariant tests for the non-SQL operators: isolation forest, classifiers,
splits, persistence, streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposcope.operators import iforest, models
from exposcope.schema import MODEL_FEATURES


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(0, 1, size=(3000, 3)).tolist()
    outl = (rng.normal(0, 1, size=(30, 3)) + 8).tolist()
    rows = [(i, *p, 0) for i, p in enumerate(pts)] + [(10000 + i, *p, 1) for i, p in enumerate(outl)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, planted int")


def test_c_factor():
    assert iforest.c_factor([2])[0] == 1.0
    assert iforest.c_factor([1])[0] == 0.0
    assert iforest.c_factor([256])[0] == pytest.approx(10.2448, abs=1e-3)


def test_isolation_forest_invariants(spark, blob):
    model = iforest.IsolationForest(num_trees=60, max_samples=128, seed=1).fit(blob, ["a", "b", "c"])
    assert model.nodes.groupby("tree").size().max() <= 2 * 128 - 1
    scored = iforest.anomaly_score(model.transform(blob), "anomaly_raw", "minmax", 0.05)
    rows = scored.select("planted", "anomaly_raw", "anomaly_score", "anomaly_flag").collect()
    raw = np.array([-r["anomaly_raw"] for r in rows])
    assert ((raw > 0) & (raw < 1)).all()
    planted = np.array([r["planted"] for r in rows]) == 1
    assert raw[planted].min() > np.median(raw[~planted])
    flagged = np.mean([r["anomaly_flag"] == -1 for r in rows])
    assert flagged == pytest.approx(0.05, abs=0.01)
    s = np.array([r["anomaly_score"] for r in rows])
    assert s.min() == pytest.approx(0.0) and s.max() == pytest.approx(1.0)


def test_forest_save_load_same_scores(spark, blob, tmp_path_factory):
    from exposcope.sources import models_io
    model = iforest.IsolationForest(num_trees=10, max_samples=64, seed=3).fit(blob, ["a", "b", "c"])
    path = str(tmp_path_factory.mktemp("forest"))
    models_io.save_forest(spark, model, path)
    back = models_io.load_forest(spark, path)
    a = [r[0] for r in model.transform(blob).orderBy("id").select("anomaly_raw").collect()]
    b = [r[0] for r in back.transform(blob).orderBy("id").select("anomaly_raw").collect()]
    assert a == b


def test_stratified_split_exact_counts(spark, sf_small):
    from exposcope.sources.standin import exposure_labeled
    d = models.stratified_split(exposure_labeled(spark, sf_small), "risk_score", 0.2, 42)
    counts = {(r["risk_score"], r["side"]): r["count"]
              for r in models.split_counts(d, "risk_score").collect()}
    for cls in {k[0] for k in counts}:
        n = counts.get((cls, "test"), 0) + counts.get((cls, "train"), 0)
        assert counts.get((cls, "test"), 0) == int(np.floor(n * 0.2 + 0.5))


def test_folds_balanced(spark, sf_small):
    from exposcope.sources.standin import exposure_labeled
    d = models.stratified_folds(exposure_labeled(spark, sf_small), "risk_score", 5)
    per = d.groupBy("risk_score", "fold").count().collect()
    by_cls = {}
    for r in per:
        by_cls.setdefault(r["risk_score"], []).append(r["count"])
    for v in by_cls.values():
        assert max(v) - min(v) <= 1


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    w = {r["y"]: r["weight"] for r in models.class_weights(df, "y").collect()}
    assert w[0] == pytest.approx(8 / (2 * 6)) and w[1] == pytest.approx(8 / (2 * 2))


def test_random_forest_beats_majority_and_reloads(spark, sf_small, tmp_path_factory):
    from exposcope.plans.ml_queries import model_table
    from exposcope.sources import models_io
    t = model_table(spark, sf_small)
    rf = models.train_rf(t.filter("is_test = 0"), MODEL_FEATURES, params=models.ForestParams(num_trees=15))
    test = t.filter("is_test = 1")
    pred = models.classify(test, rf)
    acc = pred.agg(F.avg((F.col("risk_score") == F.col("prediction")).cast("double"))).first()[0]
    majority = test.groupBy("risk_score").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority
    path = str(tmp_path_factory.mktemp("rf"))
    models_io.save_model(rf, path)
    back = models_io.load_model(spark, path)
    a = [r[0] for r in rf.transform(test).orderBy("event_id").select("prediction").collect()]
    b = [r[0] for r in back.transform(test).orderBy("event_id").select("prediction").collect()]
    assert a == b
    probs = pred.select(sum(F.col(f"prob_{i}") for i in range(5)).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in probs)


def test_stream_model_scoring_equals_batch_and_single_rows(spark, sf_small):
    """The 44-feature path (scaler, forest on its fitted offset, classifier)."""
    from exposcope.operators.encode import encode_all
    from exposcope.operators.risk import risk_score
    from exposcope.sources.standin import exposure_clean
    from exposcope.streaming import scoring
    batch = encode_all(risk_score(exposure_clean(spark, sf_small)), domain_codes=False)
    scaler, forest = models.fit_anomaly(batch, MODEL_FEATURES, iforest.IsolationForest(num_trees=20), "event_id")
    full = models.with_anomaly(batch, scaler, forest)
    rf = models.train_rf(full, [*MODEL_FEATURES, "anomaly_score"], params=models.ForestParams(num_trees=5, max_depth=4))
    fitted = models.RiskModels(scaler, forest, rf, MODEL_FEATURES)
    cols = ["event_id", "predicted_risk", "anomaly_score", "anomaly_flag", "confidence", "risk_level"]
    want = {r["event_id"]: r for r in models.predict_risk(batch, fitted).select(cols).collect()}
    s = scoring.score_stream(scoring.exposure_stream(spark, sf_small), fitted)
    got = scoring.run_available(s.select(cols), "l1_model").collect()
    assert len(got) == len(want) and all(want[r["event_id"]] == r for r in got)
    for e in list(want)[::1500]:
        one = models.predict_risk(batch.filter(F.col("event_id") == e), fitted).select(cols).collect()
        assert one == [want[e]]


def test_forest_sample_depends_on_rows_and_seed_only(spark, blob):
    a = iforest.IsolationForest(num_trees=20, max_samples=32, seed=4).fit(blob.repartition(3), ["a", "b", "c"], "id")
    b = iforest.IsolationForest(num_trees=20, max_samples=32, seed=4).fit(blob.repartition(5), ["a", "b", "c"], "id")
    c = iforest.IsolationForest(num_trees=20, max_samples=32, seed=5).fit(blob, ["a", "b", "c"], "id")
    assert a.nodes.equals(b.nodes) and a.offset == b.offset and not a.nodes.equals(c.nodes)
    few = blob.limit(40)
    d = iforest.IsolationForest(num_trees=20, max_samples=32).fit(few, ["a", "b", "c"], "id")
    assert (d.nodes[d.nodes["node"] == 0].shape[0]) == 20


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(40)], "event_id long, y int")
    folds = models.stratified_folds(df, "y", 5).collect()
    assert len(folds) == 40 and {r["fold"] for r in folds if r["y"] is None} == set(range(5))
    split = models.stratified_split(df, "y", 0.2)
    assert split.count() == 40 and split.filter("y IS NULL AND is_test = 1").count() == 2


def test_auc_matches_binary_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from exposcope.operators import metrics
    rng = np.random.default_rng(3)
    rows = [(int(y), float(np.round(s, 2)), float(np.round(1 - s, 2)))
            for y, s in zip(rng.integers(0, 2, 400), rng.random(400))]
    df = spark.createDataFrame(rows, "label int, prob_1 double, prob_0 double")
    auc = {r["class"]: r["auc"] for r in
           metrics.roc_auc(metrics.roc_points(df, "label", ["prob_0", "prob_1"])).collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob_1", labelCol="label",
                                       metricName="areaUnderROC")
    assert auc[1] == pytest.approx(ev.evaluate(df.withColumn("label", F.col("label").cast("double"))),
                                   abs=1e-9)


def test_scores_of_full_trees_equal_a_walk_by_node(spark):
    # leaves at any depth, a missing value goes to the right, trees of one node
    r = np.random.default_rng(3)
    x = r.normal(size=(5000, 4)).round(1)
    x[r.random(x.shape) < 0.05] = np.nan
    parts = []
    for t in range(12):
        some = np.nan_to_num(x[r.integers(0, len(x), 1 if t == 4 else 40)])
        got = iforest._build_tree(some, r, 6)
        parts.append(pd.DataFrame(dict(zip(["feature", "threshold", "left", "right", "size", "depth"], map(np.array, got)))).assign(tree=3 * t, node=range(len(got[0]))))
    model = iforest.IsolationForestModel(["a", "b", "c", "d"], pd.concat(parts), 40, 12, 0.05)
    want = []
    for row in x[:300]:
        total = 0.0
        for p in parts:
            at = 0
            while p["feature"].iat[at] >= 0:
                at = p["left" if row[p["feature"].iat[at]] < p["threshold"].iat[at] else "right"].iat[at]
            total += p["depth"].iat[at] + iforest.c_factor([p["size"].iat[at]])[0]
        want.append(total)
    got = iforest.path_lengths(list(x.T.copy()), *model._heaps())  # several pieces of rows
    assert len(x) > 2 * iforest.WALKED_ROWS and got[:300].tolist() == pytest.approx(want, abs=1e-12)
    df = spark.createDataFrame(pd.DataFrame(x[:300], columns=model.cols))
    raw = [v[0] for v in model.transform(df).select("anomaly_raw").collect()]
    assert raw == pytest.approx((-np.power(2.0, -np.array(want) / 12 / iforest.c_factor([40])[0])).tolist(), abs=1e-12)
