"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on word presence;
each model also gets the probabilities of the categories before it.  In training
these are out-of-fold predictions, so later models see earlier ones as they are
on unseen texts.  Models are Spark ML logistic regressions (L1).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import map_texts, table, written

#: Labelled rows that the models are fitted on (about; drawn by a hash of the id).
FIT_ROWS = 20_000
#: Tokens per category that enter the models, and rows a token must be in.
VOCABULARY, LEAST_ROWS = 2_000, 3
FOLDS, PENALTY, ITERATIONS = 3, 1e-3, 60
#: Probability from which a category holds.
THRESHOLD = 0.5
#: The chain over ``labels``: category, the SQL that makes it from a label row.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))

TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str | None) -> set[str]:
    """Distinct words and punctuation runs of the whole text, lower-cased."""
    return set(TOKEN.findall((text or "").lower()))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


@dataclass
class LinkModel:
    """One category: weights of tokens, of earlier categories' logits, and a bias."""
    category: str
    words: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    bias: float = _logit(0.0)


@dataclass
class ChainModel:
    links: list[LinkModel]

    def probabilities(self, text: str | None) -> tuple[float, ...]:
        """One probability per category, in chain order."""
        have, logits = tokens(text), []
        for m in self.links:
            z = m.bias + sum(w * x for w, x in zip(m.earlier, logits))
            z += sum(sorted(m.words[t] for t in have & m.words.keys()))
            logits.append(min(max(z, -13.8), 13.8))
        return tuple(1 / (1 + math.exp(-z)) for z in logits)


def draw(labels: DataFrame, key: str, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` labelled rows, by a hash of the id (all, if there are fewer)."""
    n = labels.count()
    if n <= rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(key), F.lit("chain")), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def vocabulary(rows: DataFrame, categories: list[str]) -> list[str]:
    """The tokens that tell a category best (chi-square on presence), by category."""
    n = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    if not n["n"]:
        return []
    each = rows.select(F.explode("tokens").alias("token"), *categories).groupBy("token") \
        .agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories]).where(F.col("df") >= LEAST_ROWS)
    each = written(each)
    out: dict[str, None] = {}
    for c in categories:
        if 0 < n[c] < n["n"]:
            expect = F.col("df") * (n[c] / n["n"])
            chi = (F.col(c) - expect) ** 2 / (expect * (1 - n[c] / n["n"]) * (1 - F.col("df") / (n["n"] + 1)))
            out |= dict.fromkeys(r["token"] for r in each.orderBy(chi.desc(), "token").limit(VOCABULARY).select("token").collect())
    return list(out)


def fit_chain(docs: DataFrame, labels: DataFrame, chain=CHAIN, key: str = "doc_id", text_col: str = "text",
              fit_rows: int = FIT_ROWS) -> ChainModel:
    """Fit the chain on labelled texts.  A category that the sample holds never or
    always gets a constant; without labels every probability is about 0.  Null
    labels count as the category not holding, null texts as texts without words."""
    names = [c for c, _ in chain]
    drawn = draw(labels.where(F.col(key).isNotNull()), key, fit_rows).select(
        F.col(key).alias("__key"), *[F.coalesce(F.expr(sql), F.lit(False)).cast("int").alias(c) for c, sql in chain])
    labelled = docs.select(F.col(key).alias("__key"), F.col(text_col).alias("__text")) \
        .join(F.broadcast(drawn), "__key")  # about fit_rows rows of a few bytes
    rows = written(map_texts(labelled, "__text", ["__key", *names], "tokens array<string>",
                             lambda: lambda texts: [(sorted(tokens(t)),) for t in texts]))
    words = vocabulary(rows, names)
    total = rows.count()
    if not total:
        return ChainModel([LinkModel(c, earlier=[0.0] * k) for k, c in enumerate(names)])
    counter = CountVectorizerModel.from_vocabulary(words or [""], "tokens", "words")
    counter.setBinary(True)
    data = written(counter.transform(rows).select(
        "__key", *names, "words",
        F.pmod(F.xxhash64("__key", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")))
    links: list[LinkModel] = []
    for k, c in enumerate(names):
        held = data.agg(F.sum(c)).first()[0]
        if not 0 < held < total or not words:
            links.append(LinkModel(c, earlier=[0.0] * k, bias=_logit((held + 0.0) / total)))
            data = data.withColumn(f"z_{k}", F.lit(links[-1].bias))
            continue
        ready = _assemble(data, k)
        model = _fit(ready, c)
        weights = model.coefficients.toArray()
        links.append(LinkModel(c, {w: float(x) for w, x in zip(words, weights) if x},
                               [float(x) for x in weights[len(words):]], float(model.intercept)))
        if k + 1 < len(names):  # out-of-fold logits for the categories to come
            parts = []
            for f in range(FOLDS):
                test, train = ready.where(F.col("fold") == f), ready.where(F.col("fold") != f)
                n, pos = train.agg(F.count("*"), F.sum(c)).first()
                if n and 0 < pos < n:
                    p = _fit(train, c).transform(test)
                    z = vector_to_array("rawPrediction")[1]
                else:
                    p, z = test, F.lit(_logit((pos or 0) / n if n else 0.0))
                parts.append(p.select("__key", *names, "words", "fold", *[f"z_{j}" for j in range(k)],
                                      F.greatest(F.lit(-13.8), F.least(F.lit(13.8), z)).alias(f"z_{k}")))
            data = parts[0]
            for p in parts[1:]:
                data = data.unionByName(p)
            data = written(data)
    return ChainModel(links)


def _assemble(data: DataFrame, k: int) -> DataFrame:
    return VectorAssembler(inputCols=["words", *[f"z_{j}" for j in range(k)]], outputCol="features").transform(data)


def _fit(rows: DataFrame, label: str):
    return LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0, regParam=PENALTY,
                              maxIter=ITERATIONS, aggregationDepth=2).fit(rows)


def score(df: DataFrame, model: ChainModel, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns plus a probability ``p_<category>`` per category.

    Null and empty texts have no words and get the models' base probabilities;
    null keys stay, repeated rows repeat, an empty table gives an empty result;
    other columns are not carried.  The model is broadcast: at most VOCABULARY
    weights per category.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"p_{m.category} double" for m in model.links)
    return map_texts(df, text_col, list(keep), schema,
                     lambda: lambda texts: [shared.value.probabilities(t) for t in texts])


@query("op8_toxicity_chain")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_chain(docs, table(spark, sf_dir, "labels"))
    toxic = F.col("p_toxic") >= THRESHOLD
    return score(docs, model).select("doc_id", "p_low_quality", "p_toxic", toxic.alias("toxic"), (~toxic).alias("kept"))
