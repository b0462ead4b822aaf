"""Splits, class weights, classifier training / cross-validation, importances
and model-based prediction (G4-G8, G14, F7).

Classifiers are this library's trees on binned features (``trees``).  Splits and
folds are exact and stratified without ranking a whole class in one task: rows are ordered by a seeded md5, bucketed by the hash prefix, and a row's
rank inside its class is (rows of the class in earlier buckets) + (rank inside
its bucket).  Buckets are uniform in size by construction, so a class holding
a third of all rows spreads over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposcope.functions.columns import risk_label
from exposcope.operators.encode import ScalerModel, fit_scaler
from exposcope.operators.iforest import IsolationForest, IsolationForestModel, anomaly_score
from exposcope.operators.joins import attach
from exposcope.operators.risk import predict_risk_rules
from exposcope.operators.trees import BoostParams, Boosted, ForestParams, TreeModel, train_boosted, train_forest


def _hash(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def bucket_prefix_len(n_rows: int, rows_per_bucket: int = 200_000) -> int:
    """Hex digits of the md5 prefix so that a class of ``n_rows`` rows spreads
    over buckets of about ``rows_per_bucket`` rows (16^k buckets)."""
    k = 1
    while 16 ** k * rows_per_bucket < n_rows and k < 8:
        k += 1
    return k


def class_rank(df: DataFrame, label: str, key: str, seed: int = 42,
               prefix_len: int | None = None) -> DataFrame:
    """Add ``__rank`` (1-based position in md5 order inside the class) and
    ``__n_class`` (class size).  The bucket table has (classes x 16^prefix_len)
    rows; by default the prefix grows with the row count (one count job)."""
    if prefix_len is None:
        prefix_len = bucket_prefix_len(df.count())
    d = df.withColumn("__h", _hash(key, seed)).withColumn("__b", F.substring("__h", 1, prefix_len))
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(label).orderBy("__b")
    counts = counts.withColumns({
        "__before": F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                               F.lit(0)),
        "__n_class": F.sum("__cnt").over(Window.partitionBy(label)),
    }).drop("__cnt")
    d = attach(d, counts, [label, "__b"])
    in_bucket = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    return d.withColumn("__rank", F.col("__before") + in_bucket).drop("__h", "__b", "__before")


def stratified_split(df: DataFrame, label: str = "risk_score", test: float = 0.2,
                     seed: int = 42, key: str = "event_id", out: str = "is_test",
                     prefix_len: int | None = None) -> DataFrame:
    """Exact stratified hold-out: per class the first round(test*n) rows in
    md5(seed-key) order are test rows (``out`` = 1).

    No full-row shuffle: bucket counts (classes x 16^k rows) locate each
    class's boundary bucket; only that bucket's (class, hash, key) slice is
    ranked to find the class's threshold hash; every row is then tagged by a
    broadcast join with the one-row-per-class threshold table.  ``key`` is
    expected unique (the model table is deduplicated); copies of one key share
    a hash and are ranked together.
    """
    if prefix_len is None:
        prefix_len = bucket_prefix_len(df.count())
    d = df.withColumn("__h", _hash(key, seed)).withColumn("__b", F.substring("__h", 1, prefix_len))
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(label).orderBy("__b")
    counts = counts.withColumns({
        "__before": F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                               F.lit(0)),
        "__target": F.floor(F.sum("__cnt").over(Window.partitionBy(label)) * test + 0.5)})
    edge = counts.filter((F.col("__before") < F.col("__target"))
                         & (F.col("__before") + F.col("__cnt") >= F.col("__target"))) \
        .select(label, F.col("__b").alias("__edge"), (F.col("__target") - F.col("__before"))
                .alias("__need"))
    slim = (d.select(label, "__b", "__h", F.col(key).cast("string").alias("__k"))
            )
    slim = attach(slim, edge, [label]).where(F.col("__b") == F.col("__edge"))
    rn = F.row_number().over(Window.partitionBy(label).orderBy("__h", "__k"))
    thr = (slim.withColumn("__rn", rn).filter(F.col("__rn") == F.col("__need"))
           .select(label, "__edge", F.col("__h").alias("__th"), F.col("__k").alias("__tk")))
    tagged = attach(d, thr, [label], "left")
    key_s = F.col(key).cast("string")
    inside = (F.col("__b") < F.col("__edge")) | (
        (F.col("__b") == F.col("__edge"))
        & ((F.col("__h") < F.col("__th")) | ((F.col("__h") == F.col("__th")) & (key_s <= F.col("__tk")))))
    return (tagged.withColumn(out, F.coalesce(inside, F.lit(False)).cast("int"))
            .drop("__h", "__b", "__edge", "__th", "__tk"))


def stratified_folds(df: DataFrame, label: str = "risk_score", k: int = 5, seed: int = 42,
                     key: str = "event_id", out: str = "fold") -> DataFrame:
    """Fold id 0..k-1 dealt round-robin in md5 order within each class."""
    r = class_rank(df, label, key, seed)
    return r.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__n_class")


def split_counts(df: DataFrame, label: str = "risk_score", flag: str = "is_test") -> DataFrame:
    """Class counts on each side of the split."""
    return df.groupBy(label, F.when(F.col(flag) == 1, "test").otherwise("train").alias("side")) \
        .agg(F.count(F.lit(1)).alias("count"))


def class_weights(df: DataFrame, label: str = "risk_score") -> DataFrame:
    """Balanced weights n / (k * n_c) — one row per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    all_ = Window.partitionBy()
    return c.withColumn("weight", F.sum("count").over(all_)
                        / (F.count(F.lit(1)).over(all_) * F.col("count")))


def with_class_weights(df: DataFrame, label: str = "risk_score", out: str = "weight",
                       fit_on: DataFrame | None = None) -> DataFrame:
    """Attach the balanced weight of each row's class, fitted on ``fit_on`` (the
    training rows; ``df`` if none are given).  Classes not seen there get none."""
    w = class_weights(df if fit_on is None else fit_on, label).select(label, F.col("weight").alias(out))
    return attach(df, w, [label], "left")


# ---------------------------------------------------------------- classifiers
def train_rf(train: DataFrame, features: Sequence[str], label: str = "risk_score", key: str = "event_id",
             params: ForestParams | None = None) -> TreeModel:
    """Random forest with balanced class weights."""
    return train_forest(train, features, label, key, params)


def train_gbt(train: DataFrame, features: Sequence[str], label: str = "risk_score", key: str = "event_id",
              params: BoostParams | None = None) -> Boosted:
    """Multiclass boosted trees with softmax, L1 and L2."""
    return train_boosted(train, features, label, key, params)


def confidence(pred: DataFrame, n_classes: int = 5, prefix: str = "prob_",
               out: str = "confidence") -> DataFrame:
    return pred.withColumn(out, F.greatest(*[F.col(f"{prefix}{i}") for i in range(n_classes)]))


def cross_validate_forest(df: DataFrame, features: Sequence[str], label: str = "risk_score", key: str = "event_id",
                          k: int = 5, params: ForestParams | None = None, fold_col: str = "fold") -> DataFrame:
    """Out-of-fold predictions.  ``df`` carries ``fold_col`` (see ``stratified_folds``);
    the forests of all folds grow in the same passes, each without its fold's rows.
    Returns ``df`` with probabilities and prediction; class weights are those of all rows,
    which stratified folds share."""
    model = train_forest(df, features, label, key, params, fold_col, k)
    parts = [model.transform(df.where(F.col(fold_col) == f), f) for f in range(k)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate_boosted(df: DataFrame, features: Sequence[str], label: str = "risk_score", key: str = "event_id",
                           k: int = 5, params: BoostParams | None = None, fold_col: str = "fold") -> DataFrame:
    """G8 for boosted trees: ``label``, ``fold_col``, probabilities and prediction per row of
    ``df``; the margins that training carries for a row's own fold are its out-of-fold prediction."""
    got = train_boosted(df, features, label, key, params, fold_col, k).out_of_fold()
    return got.withColumnsRenamed({"y": label, "fold": fold_col}).drop("rid")


def fold_accuracy(pred: DataFrame, label: str, prediction: str, fold_col: str = "fold") -> DataFrame:
    """G8 for a fixed scorer: accuracy per fold, then mean and population std."""
    per = pred.groupBy(fold_col).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("acc"))
    return per.agg(F.avg("acc").alias("cv_accuracy"), F.stddev_pop("acc").alias("cv_std"),
                   F.count(F.lit(1)).alias("folds"))


def feature_importances(model: TreeModel, k: int | None = None) -> DataFrame:
    """Named importances, largest first (top ``k``)."""
    rows = [(c, float(v)) for c, v in zip(model.cols, model.importances())]
    df = model.trees.sparkSession.createDataFrame(rows, "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.limit(k) if k else df


def classify(df: DataFrame, classifier: TreeModel) -> DataFrame:
    """A trained classifier's class, per-class probabilities, confidence (largest
    probability) and level name, for rows with its features."""
    pred = confidence(classifier.transform(df), classifier.classes)
    pred = pred.withColumn("predicted_risk", F.col("prediction").cast("int"))
    return pred.withColumn("risk_level", risk_label(F.col("predicted_risk")))


@dataclass
class RiskModels:
    """What F7 needs of a training run; every part is fitted on training rows."""
    scaler: ScalerModel
    forest: IsolationForestModel
    classifier: TreeModel
    features: list[str]


def fit_anomaly(train: DataFrame, features: Sequence[str], forest: IsolationForest | None = None,
                key: str | None = None) -> tuple[ScalerModel, IsolationForestModel]:
    """Scaler and isolation forest (with its offset) over the training rows."""
    scaler = fit_scaler(train, features)
    scaled = scaler.transform(train, suffix="__z")
    model = (forest or IsolationForest()).fit(scaled, [f"{c}__z" for c in features], key)
    return scaler, model


def with_anomaly(df: DataFrame, scaler: ScalerModel, forest: IsolationForestModel) -> DataFrame:
    """``df`` with anomaly_score, anomaly_decision and anomaly_flag on the fitted
    offset; a projection, so one row, a batch and a stream agree."""
    scaled = scaler.transform(df.drop("anomaly_score"), suffix="__z")
    scored = anomaly_score(forest.transform(scaled), mode="fixed", offset=forest.offset)
    return scored.drop("anomaly_raw", *[f"{c}__z" for c in scaler.cols])


def predict_risk(df: DataFrame, models: RiskModels | None = None) -> DataFrame:
    """scale -> anomaly score -> classifier on the features and that score ->
    class, probabilities, confidence, level.  Without models the rule path."""
    if models is None:
        return predict_risk_rules(df)
    full = with_anomaly(df, models.scaler, models.forest)
    return classify(full, models.classifier)
