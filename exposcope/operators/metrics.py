"""Classification evaluation (G9-G13) from (label, prediction) counts.

Every metric is arithmetic on the small table of (label, prediction) pair
counts, which a partial aggregation produces in one pass; ROC curves use
counts per distinct (rounded) score, so their size is bounded by the score
grid, not by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposcope.operators.joins import attach, running_count
from exposcope.session import cut_lineage

from exposcope.schema import RISK_LABELS


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).cast("int").alias("label"),
                        F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """G10 body: per class tp, support, predicted, precision, recall, f1 (0 on empty).

    Classes are those seen as label or prediction.  Each (label, prediction)
    count adds to its label's support / tp and to its prediction's predicted
    count: one explode + one aggregation over the pair counts, no joins.
    """
    pc = pair_counts(pred, label, prediction)
    hit = (F.col("label") == F.col("prediction")).cast("long")
    parts = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 (F.col("n") * hit).alias("tp"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")))
    t = (pc.select(F.explode(parts).alias("x")).select("x.*")
         .groupBy("cls").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                             F.sum("predicted").alias("predicted")))
    p = F.when(F.col("predicted") == 0, 0.0).otherwise(F.col("tp") / F.col("predicted"))
    r = F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support"))
    t = t.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return t.withColumn("f1", f1).select(
        F.col("cls").cast("int").alias("class"), "precision", "recall", "f1",
        F.col("support").cast("long").alias("support"), F.col("tp").cast("long").alias("tp"),
        F.col("predicted").cast("long").alias("predicted"))


def classification_metrics(pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (one row)."""
    pc = per_class(pred, label, prediction)
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           names: Sequence[str] = RISK_LABELS) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    pc = per_class(pred, label, prediction)
    name_map = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    rows = pc.select(F.coalesce(name_map[F.col("class")], F.col("class").cast("string"))
                     .alias("row"), "precision", "recall", "f1", "support")
    tot = pc.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     (F.col("tp") / F.col("n")).alias("f1"), F.col("n").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("row"),
                          (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"),
                          (F.col("wf") / F.col("n")).alias("f1"),
                          F.col("n").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: Sequence[int] = tuple(range(5))) -> DataFrame:
    """rows = true class, one count column per predicted class; with a
    prediction outside ``classes`` (or none) there is a column ``pred_other`` too."""
    counts = cut_lineage(pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).alias("p"))
                         .agg(F.count(F.lit(1)).alias("n")))
    known = F.coalesce(F.col("p").isin(list(classes)), F.lit(False))
    cols = [F.coalesce(F.sum(F.when(F.col("p") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes]
    if counts.where(~known).limit(1).count():
        cols.append(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("long").alias("pred_other"))
    return counts.groupBy("label").agg(*cols)


def roc_points(pred: DataFrame, label: str = "label",
               score_cols: Sequence[str] = tuple(f"prob_{i}" for i in range(5)),
               digits: int | None = None) -> DataFrame:
    """One-vs-rest ROC points per class at every distinct score (ties merged),
    exact on the scores as they are (``digits`` rounds them first).  Cumulative
    counts are running counts over range partitions, so no task holds a class.
    """
    def sc(c):
        x = F.col(c).cast("double")
        return F.round(x, digits) if digits is not None else x

    arr = F.array(*[F.struct(F.lit(i).alias("cls"), sc(c).alias("score"))
                    for i, c in enumerate(score_cols)])
    long = pred.select(F.col(label).cast("int").alias("__y"), F.explode(arr).alias("__s"))
    long = long.select(F.col("__s.cls").alias("class"), F.col("__s.score").alias("score"),
                       (F.col("__y") == F.col("__s.cls")).cast("long").alias("pos"))
    g = long.groupBy("class", "score").agg(F.sum("pos").alias("p"),
                                           F.sum(1 - F.col("pos")).alias("q"))
    g = cut_lineage(g)
    total = g.groupBy("class").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    g = running_count(running_count(g, ["class"], "score", "p", "bp", descending=True),
                      ["class"], "score", "q", "bq", descending=True)
    g = attach(g, total, ["class"]).withColumns({"cum_p": F.col("bp") + F.col("p"), "cum_q": F.col("bq") + F.col("q")})
    return g.select("class", "score",
                    F.when(F.col("all_p") == 0, None).otherwise(F.col("cum_p") / F.col("all_p")).alias("tpr"),
                    F.when(F.col("all_q") == 0, None).otherwise(F.col("cum_q") / F.col("all_q")).alias("fpr"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area under each class's ROC points (starting at 0,0)."""
    w = Window.partitionBy("class").orderBy(F.col("score").desc())
    d = points.withColumns({"__fp": F.coalesce(F.lag("fpr").over(w), F.lit(0.0)),
                            "__tp": F.coalesce(F.lag("tpr").over(w), F.lit(0.0))})
    return d.groupBy("class").agg(
        F.sum((F.col("fpr") - F.col("__fp")) * (F.col("tpr") + F.col("__tp")) / 2).alias("auc"))


def compare_models(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack one-row metric tables under a ``model`` name column."""
    out = None
    for name, m in named:
        m = m.select(F.lit(name).alias("model"), *m.columns)
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    return out


def best_model(metrics: DataFrame, model_col: str = "model", by: str = "accuracy") -> DataFrame:
    """Row of the best model (highest ``by``; name ascending breaks ties)."""
    return metrics.orderBy(F.col(by).desc(), F.col(model_col)).limit(1)
