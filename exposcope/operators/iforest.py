"""Isolation forest (G1) and anomaly normalisation / summary.

Spark has no isolation forest, so it is built from DataFrame pieces:

* **sampling** — every row has an independent hash per (seed, slot) that deals
  it to a tree or to none, so the sample depends on the rows and the seed only,
  not on partitions; a per-tree ``row_number`` keeps ``psi`` distinct rows.
  A tree has about ``oversample * psi`` candidates, whatever the data size.
* **building** — ``groupBy(tree).applyInPandas``: one small numpy tree per
  group (at most ``2 * psi - 1`` nodes, height limit ceil(log2 psi)).
* **scoring** — the forest table has a size bound fixed by the parameters
  (``trees * (2 * psi - 1)`` nodes), checked before it is broadcast; a Pandas
  UDF over the feature columns alone returns one double per row.
* **offset** — the contamination quantile of the training scores, fitted and
  saved with the forest, so single rows and streams are judged as in batch.

Score (Liu, Ting & Zhou 2008): s(x) = 2^(-E[h(x)] / c(psi)), with
c(n) = 2 (ln(n-1) + 0.5772156649) - 2 (n-1)/n for n > 2, c(2) = 1, else 0.
``anomaly_raw`` is -s (higher = more normal), the usual "score_samples".
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposcope.session import cut_lineage, ship_package

EULER_GAMMA = 0.5772156649
#: Rows that a task walks down a tree at one time.
WALKED_ROWS = 2048

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Random isolation tree over the rows of x as flat node arrays."""
    feat, thr, left, right, size, depth = [], [], [], [], [], []
    stack = [(np.arange(x.shape[0]), 0, -1, False)]
    while stack:
        idx, d, parent, is_right = stack.pop()
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1)
        size.append(len(idx)), depth.append(d)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        if d >= limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        movable = np.flatnonzero(hi > lo)
        if movable.size == 0:
            continue
        q = int(rng.choice(movable))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        feat[node], thr[node], size[node] = q, p, -1
        stack.append((idx[~go_left], d + 1, node, True))
        stack.append((idx[go_left], d + 1, node, False))
    return feat, thr, left, right, size, depth


class IsolationForestModel:
    def __init__(self, cols: Sequence[str], nodes: pd.DataFrame, psi: int, num_trees: int,
                 contamination: float, offset: float | None = None):
        self.offset = offset
        self.cols, self.psi, self.num_trees = list(cols), psi, num_trees
        self.contamination = contamination
        self.nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)

    def _heaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trees present as full binary trees of one depth, children of i at 2 i and
        2 i + 1: (trees, inner nodes) of features and thresholds, and (trees, last level) of
        path lengths.  A leaf above the last level hands its value to all below it."""
        nd = self.nodes
        tree = np.unique(nd["tree"].to_numpy(), return_inverse=True)[1]
        count, depth = int(tree.max()) + 1, int(nd["depth"].max())
        node, size, level = nd["node"].to_numpy(np.int64), nd["size"].to_numpy(), nd["depth"].to_numpy(np.int64)
        feature, threshold = np.zeros((count, 1 << depth), np.int64), np.zeros((count, 1 << depth))
        length = np.zeros((count, 1 << depth))
        at = np.zeros((count, int(node.max()) + 1), np.int64)  # place of each node
        at[:, 0] = 1
        inner = nd["feature"].to_numpy() >= 0
        path = level + c_factor(np.maximum(size, 0))
        for d in range(depth + 1):
            i = np.flatnonzero(inner & (level == d))
            t, here = tree[i], at[tree[i], node[i]]
            feature[t, here], threshold[t, here] = nd["feature"].to_numpy()[i], nd["threshold"].to_numpy()[i]
            at[t, nd["left"].to_numpy()[i]], at[t, nd["right"].to_numpy()[i]] = 2 * here, 2 * here + 1
            i = np.flatnonzero(~inner & (level == d))
            below = 1 << (depth - d)
            where = ((at[tree[i], node[i]] << (depth - d)) - (1 << depth))[:, None] + np.arange(below)
            length[tree[i][:, None], where] = path[i][:, None]
        return feature, threshold, length

    def transform(self, df: DataFrame, out: str = "anomaly_raw") -> DataFrame:
        """Add ``out`` = -2^(-E[h]/c(psi)) for every row (higher = more normal)."""
        spark = df.sparkSession
        ship_package(spark)
        bc = spark.sparkContext.broadcast(self._heaps())
        cpsi = float(c_factor([self.psi])[0]) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in batches:
                total = path_lengths([s.to_numpy(dtype="float64") for s in series], *bc.value)
                yield pd.Series(-np.power(2.0, -(total / len(bc.value[0])) / cpsi))

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.cols]))


def path_lengths(columns: Sequence[np.ndarray], feature: np.ndarray, threshold: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the rows' path lengths over the trees of ``_heaps``, some rows at a time (to
    stay in the processor's cache).  A missing value goes to the right."""
    n = len(columns[0])
    total, leaves = np.zeros(n), length.shape[1]
    for a in range(0, n, WALKED_ROWS):
        x = np.column_stack([c[a:a + WALKED_ROWS] for c in columns])
        flat, base, sums = x.reshape(-1), np.arange(len(x)) * x.shape[1], total[a:a + WALKED_ROWS]
        for f, cut, value in zip(feature, threshold, length):
            at = np.ones(len(x), np.int64)
            for _ in range(leaves.bit_length() - 1):
                right = ~(flat.take(f.take(at) + base) < cut.take(at))
                at += at
                at += right
            sums += value.take(at - leaves)
    return total


class IsolationForest:
    """G1 estimator: ``fit(df, cols)`` -> ``IsolationForestModel``."""

    def __init__(self, num_trees: int = 200, max_samples: int = 256,
                 contamination: float = 0.05, seed: int = 42, oversample: float = 1.5):
        self.num_trees, self.max_samples = num_trees, max_samples
        self.contamination, self.seed, self.oversample = contamination, seed, oversample

    def fit(self, df: DataFrame, cols: Sequence[str], key: str | None = None) -> IsolationForestModel:
        """``key`` names a row (else its features do); equal keys count as one row
        of a tree's sample."""
        ship_package(df.sparkSession)
        cols = list(cols)
        n = df.count()
        if n == 0:
            raise ValueError("isolation forest needs at least one row")
        trees, psi = self.num_trees, min(self.max_samples, n)
        want = self.oversample * psi * trees / n  # draws per row
        base = df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                         (F.xxhash64(F.col(key)) if key else F.xxhash64(*cols)).alias("__key"))

        def hashed(*what):
            return F.xxhash64("__key", F.lit(self.seed), *what)

        if want >= trees / 2:  # few rows: each is a candidate of every tree
            s = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        else:  # each slot deals the row to one of the trees, the last one by chance
            slots = max(1, math.ceil(want))
            share = want / slots
            s = (base.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
                 .where(F.pmod(hashed(F.lit("kept"), F.col("__slot")), F.lit(1 << 40)) < int(share * (1 << 40)))
                 .withColumn("tree", F.pmod(hashed(F.lit("tree"), F.col("__slot")), F.lit(trees)).cast("int"))
                 .drop("__slot").dropDuplicates(["tree", "__key"]))
        s = s.withColumn("__rn", F.row_number().over(
            Window.partitionBy("tree").orderBy(hashed(F.lit("order"), F.col("tree")), "__key")))
        s = s.filter(F.col("__rn") <= psi).select("tree", "__rn", *cols)

        limit = int(math.ceil(math.log2(max(psi, 2))))
        seed = self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            pdf = pdf.sort_values("__rn")
            rng = np.random.default_rng([seed, t])
            feat, thr, left, right, size, depth = _build_tree(
                pdf[cols].to_numpy(dtype="float64"), rng, limit)
            m = len(feat)
            return pd.DataFrame({"tree": np.full(m, t, dtype="int32"),
                                 "node": np.arange(m, dtype="int32"),
                                 "feature": np.asarray(feat, dtype="int32"),
                                 "threshold": np.asarray(thr, dtype="float64"),
                                 "left": np.asarray(left, dtype="int32"),
                                 "right": np.asarray(right, dtype="int32"),
                                 "size": np.asarray(size, dtype="int32"),
                                 "depth": np.asarray(depth, dtype="int32")})

        forest = s.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
        bound = trees * (2 * psi - 1)
        nodes = forest.toPandas()
        if len(nodes) > bound:  # cannot happen: each tree has <= 2 psi - 1 nodes
            raise RuntimeError(f"forest larger than its bound {bound}")
        got = nodes["tree"].nunique()
        model = IsolationForestModel(cols, nodes, psi, max(got, 1), self.contamination)
        from exposcope.operators.quantiles import exact_quantiles
        raw = cut_lineage(model.transform(df.select(*cols)).select("anomaly_raw"))
        model.offset = exact_quantiles(raw, ["anomaly_raw"], [self.contamination])["anomaly_raw"][0]
        return model


def anomaly_score(scored: DataFrame, raw: str = "anomaly_raw", mode: str = "minmax",
                  contamination: float = 0.05, out: str = "anomaly_score",
                  flag: str = "anomaly_flag", offset: float | None = None) -> DataFrame:
    """decision = raw - offset; flag -1 below 0.

    ``minmax``: 1 - (d - min d) / (max d - min d) over the batch; without an
    ``offset`` the batch's own contamination quantile is taken.
    ``fixed``: clip(1 - (d + 0.5), 0, 1), a projection for single rows and
    streams; it needs the offset that was fitted in training.
    """
    if mode == "fixed":
        if offset is None:
            raise ValueError("fixed scores need the fitted offset")
        d = F.col(raw) - F.lit(offset)
        score = F.least(F.greatest(1.0 - (d + 0.5), F.lit(0.0)), F.lit(1.0))
    elif mode == "minmax":
        from exposcope.operators.quantiles import exact_quantiles
        ends = [F.min(raw).alias("lo"), F.max(raw).alias("hi")]
        if offset is None:
            got = exact_quantiles(scored, [raw], [contamination], extra=ends)
            offset, ends = got[raw][0], got["__extra"]
        else:
            ends = scored.agg(*ends).first().asDict()
        d = F.col(raw) - F.lit(offset).cast("double")
        lo, hi = ends["lo"], ends["hi"]
        span = (hi - lo) if lo is not None and hi != lo else 1.0
        score = 1.0 - (F.col(raw) - F.lit(lo).cast("double")) / F.lit(span)
    else:
        raise ValueError(mode)
    return scored.withColumns({"anomaly_decision": d, out: score,
                               flag: F.when(d < 0, -1).otherwise(1).cast("int")})


def anomaly_summary(df: DataFrame, score: str = "anomaly_score", flag: str = "anomaly_flag") -> DataFrame:
    """Anomalies flagged, their %, and min / max / mean of the score."""
    return df.agg(F.count_if(F.col(flag) == -1).alias("anomalies"),
                  (F.count_if(F.col(flag) == -1) * 100.0 / F.count(F.lit(1))).alias("anomaly_pct"),
                  F.min(score).alias("score_min"), F.max(score).alias("score_max"),
                  F.avg(score).alias("score_mean"))
