"""Language identification by nearest centroid.

Texts are normalised TF-IDF vectors of hashed character n-grams.  Every language
has several centroids (spherical k-means over a bounded sample of its texts); a
text takes the language of the nearest centroid by cosine.  A text farther from
its centroid than nearly all texts of that cluster is marked rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import map_texts, table
from exposcope.session import ship_package

#: Hashed dimensions and n-gram lengths.
DIMENSIONS, LENGTHS = 1 << 13, (1, 2, 3)
#: Centroids per language, k-means rounds, and the sample a language is fitted on (about so many rows).
CENTROIDS, ROUNDS, FIT_ROWS = 4, 8, 600
#: Share of a cluster's sample that may lie beyond its rejection distance, and the slack on it.
REJECT_SHARE, SLACK = 0.005, 0.15
#: Languages that a model may hold (each has CENTROIDS vectors of DIMENSIONS floats).
MOST_LANGUAGES = 500
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts over the whole text (letters lower-cased, all else one blank); None without a letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.where(_letters()[x], x, np.uint32(32))
    blank = x == 32
    if blank.all():
        return None
    x = np.concatenate([[np.uint32(32)], x[~(blank & np.roll(blank, 1))], [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            h = (h[: len(x) - n + 1] ^ (h[: len(x) - n + 1] >> np.uint32(15))) * _MULTIPLY[0] + x[n - 1:] * _MULTIPLY[n - 1]
            if n in LENGTHS:
                total += np.bincount((h * _MULTIPLY[2]) >> np.uint32(32 - 13), minlength=DIMENSIONS)
    return total


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text)
    if c is None:
        return None
    v = np.log1p(c) * idf
    return (v / np.linalg.norm(v)).astype(np.float32)


def document_frequencies(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """(texts, dimension -> texts with it) over all rows: one partial vector per task, summed in Spark."""
    ship_package(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for f in frames:
            for t in f[text_col]:
                c = counts(t)
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        if df[-1]:
            yield pd.DataFrame({"dim": np.arange(DIMENSIONS + 1, dtype=np.int32), "n": df})

    rows = texts.select(text_col).mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["dim"]] = r["n"]
    return out


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeds; unit centroids and each row's cluster."""
    first = int(np.argmax(vectors @ vectors.mean(axis=0)))
    seeds = [first]
    near = vectors @ vectors[first]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centre = vectors[seeds].copy()
    for _ in range(rounds):
        mine = np.argmax(vectors @ centre.T, axis=1)
        for c in range(len(centre)):
            if (mine == c).any():
                m = vectors[mine == c].sum(axis=0)
                centre[c] = m / np.linalg.norm(m)
    return centre, np.argmax(vectors @ centre.T, axis=1)


@dataclass
class CentroidModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected
    idf: np.ndarray

    def predict(self, texts: list) -> list[tuple]:
        """(lang, cosine, rejected) per text."""
        out: list[tuple] = [("und", 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for at in range(0, len(texts), 256):
            rows = [(k, v) for k in range(at, min(at + 256, len(texts)))
                    if (v := vector(texts[k], self.idf)) is not None]
            if rows:
                cos = np.stack([v for _, v in rows]) @ self.centroids.T
                best = cos.argmax(axis=1)
                for (k, _), b, c in zip(rows, best, cos.max(axis=1)):
                    out[k] = (self.languages[b], float(min(max(c, 0.0), 1.0)), bool(c < self.least[b]))
        return out


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id",
        fit_rows: int = FIT_ROWS) -> CentroidModel:
    """Fit on rows with a language.  Document frequencies cover every row; centroids
    come from about ``fit_rows`` rows per language, drawn by a hash of ``key_col``
    (a documented bound: one task fits one language from at most that sample)."""
    train = train.where(F.col(lang_col).isNotNull())
    df = document_frequencies(train, text_col)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().orderBy(lang_col).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes or not df[-1]:
        return CentroidModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), idf)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, fit_rows / n).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col(key_col), F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000
    sample = train.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                                       F.xxhash64(F.col(key_col), F.col(text_col)).alias("order"))

    def fit_one(f: pd.DataFrame) -> pd.DataFrame:
        rows = [v for t in f.sort_values("order")["text"] if (v := vector(t, idf)) is not None]
        if not rows:
            return pd.DataFrame({"lang": [], "vector": [], "least": []})
        x = np.stack(rows)
        centre, mine = cluster(x)
        cos = (x * centre[mine]).sum(axis=1)
        keep = [c for c in range(len(centre)) if (mine == c).any()]
        return pd.DataFrame({"lang": f["lang"].iat[0], "vector": [centre[c].astype("<f4").tobytes() for c in keep],
                             "least": [float(np.quantile(cos[mine == c], REJECT_SHARE) - SLACK) for c in keep]})

    got = sample.groupBy("lang").applyInPandas(fit_one, "lang string, vector binary, least double").collect()
    got.sort(key=lambda r: (r["lang"], r["vector"]))
    return CentroidModel([r["lang"] for r in got],
                         np.array([np.frombuffer(r["vector"], "<f4") for r in got], np.float32).reshape(-1, DIMENSIONS),
                         np.array([r["least"] for r in got]), idf)


def predict(df: DataFrame, model: CentroidModel, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score (cosine to the nearest centroid, 0 to 1)
    and rejected.

    Null texts and texts without a letter are ``und`` with score 0, rejected, and
    so is every text if the model learned no language.  Null keys stay, repeated
    rows repeat, an empty table gives an empty result; other columns are not
    carried.  Ties go to the language that sorts first.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, text_col, list(keep), "lang_pred string, score double, rejected boolean",
                     lambda: shared.value.predict)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0 (null ids never train)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
