"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages; only the text has a label.  Every passage is encoded
(byte and byte-pair frequencies and a few shape figures, through a learned layer);
gated attention weighs the passages of a text, the weighted mean of the encodings
is its representation, and a logistic unit scores it.  Encoder, attention and
scorer are learned together from the labels of the texts.

Training is data-parallel: the bounded sample of labelled texts is dealt to shards
by hash; in each round every shard goes over its texts from the common parameters,
and the shards' parameters are averaged.  Scoring is one map over whole texts that
holds one slice of a text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import broadcast_if_small, map_texts, table, written
from exposcope.session import ship_package

#: Words of a passage; a run of more than RUN bytes without white space counts as several words.
PASSAGE, RUN = 64, 32
#: Bytes of a text that are encoded at one time; passages don't cross such a slice.
SLICE_BYTES = 1 << 18
#: Hashed byte pairs, figures of a passage, width of the encoding and of the attention.
PAIRS, FIGURES, ENCODING, ATTENTION = 256, 6, 24, 12
WIDTH = 256 + PAIRS + FIGURES
#: Labelled texts that the model is fitted on (about; by a hash of the id), and passages of each
#: (evenly spread; scores always cover all passages).
FIT_ROWS, FIT_PASSAGES = 8_000, 128
#: Shards, rounds, passes of a shard over its texts per round and steps at least, texts of a step,
#: step size, weight decay.
SHARDS, FIT_ROUNDS, PASSES, LEAST_STEPS, STEP_TEXTS, RATE, DECAY = 4, 6, 3, 60, 32, 0.01, 1e-4
#: Score from which a text is predicted to be of label 1 (fixed by the task).
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 other printable ASCII but letters, 4 white space
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_POWERS = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * RUN, np.uint64), dtype=np.uint64)


def slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that end at a blank or line end where the last quarter has one."""
    at = 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", end - SLICE_BYTES // 4, end), text.rfind(b"\n", end - SLICE_BYTES // 4, end))
            end = cut + 1 if cut >= 0 else end
        yield text[at:end]
        at = end


def passages(text: bytes) -> np.ndarray:
    """(passages, WIDTH) counts of one slice: bytes, hashed byte pairs, then figures in
    thousandths; no row if there is no word."""
    b = np.frombuffer(text, np.uint8)
    kind = _KIND[b]
    word = kind != 4
    if not word.any():
        return np.zeros((0, WIDTH), np.uint16)
    at = np.arange(len(b))
    edge = word & ~np.concatenate([[False], word[:-1]])
    begin = np.maximum.accumulate(np.where(edge, at, 0))  # of the run that a byte is in
    start = word & ((at - begin) % RUN == 0)
    index = np.cumsum(start) - 1  # of a byte's word; blanks go with the word before
    first = np.flatnonzero(start)
    part = np.maximum(index, 0) // PASSAGE
    n = int(part[-1]) + 1
    out = np.zeros((n, WIDTH), np.uint16)
    out[:, :256] = np.bincount(part * 256 + b, minlength=n * 256).reshape(n, 256)
    pair = ((b[:-1].astype(np.uint32) * np.uint32(0x01000193)) ^ b[1:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
    out[:, 256:256 + PAIRS] = np.bincount(part[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.bincount(part, minlength=n)
    shares = [np.bincount(part, kind == k, n) / size for k in (1, 2, 3)]
    # words as hashes: how many of a passage are new in it, and new in the slice
    lower = np.where(word, np.where(kind == 1, b + 32, b), 0).astype(np.uint64)
    hashes = np.add.reduceat(lower * _POWERS[np.where(word, (at - begin) % RUN, 0)], first)
    owner = np.arange(len(first)) // PASSAGE
    words = np.bincount(owner, minlength=n)
    by = np.lexsort((owner, hashes))
    h, o = hashes[by], owner[by]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    own = new | np.concatenate([[True], o[1:] != o[:-1]])
    shares += [np.bincount(o, own, n) / words, np.bincount(o, new, n) / words, size / words / (RUN + 1)]
    out[:, 256 + PAIRS:] = np.rint(np.minimum(np.stack(shares, axis=1), 10) * 1000)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Inputs of the encoder: roots of frequencies, figures as shares."""
    x = counts.astype(np.float32)
    for lo, hi in ((0, 256), (256, 256 + PAIRS)):
        x[:, lo:hi] = np.sqrt(x[:, lo:hi] / np.maximum(x[:, lo:hi].sum(axis=1, keepdims=True), 1))
    x[:, 256 + PAIRS:] /= 1000
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Parameters: encoder (w, b), attention gates (v, u), attention weights (a), scorer (c, d)."""
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    @staticmethod
    def start(seed: int = 13) -> "AttentionModel":
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        return AttentionModel(draw(WIDTH, ENCODING) * 4, np.zeros(ENCODING, np.float32), draw(ENCODING, ATTENTION),
                              draw(ENCODING, ATTENTION), draw(ATTENTION), np.zeros(ENCODING, np.float32), np.zeros(1, np.float32))

    def all(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.all()])

    def with_flat(self, flat: np.ndarray) -> "AttentionModel":
        out, at = [], 0
        for p in self.all():
            out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return AttentionModel(*out)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of passages and the logarithms of their attention weights, up to a constant."""
        h = np.tanh(x @ self.w + self.b)
        return h, (np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.a

    def score(self, text: bytes | None) -> tuple[float, float]:
        """(score, weight of the passage that counts most); a text without words is
        one passage without anything in it."""
        top, total, z = -np.inf, 0.0, np.zeros(ENCODING)
        for piece in slices(text or b""):
            counts = passages(piece)
            for k in range(0, len(counts), 512):
                h, e = self.encode(scaled(counts[k:k + 512]))
                peak = max(top, float(e.max()))  # a running softmax over the slices
                old, new = np.exp(top - peak) if total else 0.0, np.exp(e - peak)
                total, z, top = total * old + float(new.sum()), z * old + new @ h, peak
        if not total:
            h, _ = self.encode(np.zeros((1, WIDTH), np.float32))
            total, z = 1.0, h[0].astype(np.float64)
        return float(_sigmoid(z @ self.c / total + self.d[0])), float(min(1.0 / total, 1.0))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over texts whose passages start at ``starts`` in ``x``."""
        sizes = np.diff(np.append(starts, len(x)))
        each = lambda m: np.repeat(m, sizes, axis=0)
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * s) @ self.a
        e = np.exp(e - each(np.maximum.reduceat(e, starts)))
        att = e / each(np.add.reduceat(e, starts))
        z = np.add.reduceat(att[:, None] * h, starts)
        g = ((_sigmoid(z @ self.c + self.d[0]) - y) / len(y)).astype(np.float32)
        dz = each(g[:, None] * self.c)
        da = (h * dz).sum(axis=1)
        de = att * (da - each(np.add.reduceat(att * da, starts)))
        dg = de[:, None] * self.a
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (att[:, None] * dz + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()], np.float32)]


def train_shard(model: AttentionModel, bags: list[np.ndarray], y: np.ndarray, rate: float, seed: int) -> AttentionModel:
    """Adam over the texts of one shard, in an order drawn from ``seed``."""
    r = np.random.default_rng(seed)
    one = [np.zeros_like(p) for p in model.all()]
    two = [np.zeros_like(p) for p in model.all()]
    step, parts = 0, -(-len(bags) // STEP_TEXTS)
    for _ in range(max(PASSES, -(-LEAST_STEPS // parts))):
        for rows in np.array_split(r.permutation(len(bags)), parts):
            step += 1
            some = [bags[k] for k in rows]
            starts = np.cumsum([0] + [len(s) for s in some[:-1]])
            grads = model.gradients(scaled(np.concatenate(some)), starts, y[rows].astype(np.float32))
            for p, g, m, v in zip(model.all(), grads, one, two):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def bag(text: bytes | None, most: int = FIT_PASSAGES) -> np.ndarray:
    """Counts of a text's passages, at most ``most`` of them, evenly spread; one empty
    passage for a text without words."""
    found = [p for piece in slices(text or b"") if len(p := passages(piece))]
    if not found:
        return np.zeros((1, WIDTH), np.uint16)
    counts = np.concatenate(found)
    return counts if len(counts) <= most else counts[np.linspace(0, len(counts) - 1, most).astype(int)]


def sample(docs: DataFrame, labels: DataFrame, label_col: str, key: str, text_col: str, rows: int) -> DataFrame:
    """(order, y, bag): about ``rows`` labelled texts.  Labels of one id count as their
    mean, equal rows of ``docs`` once; null ids, null labels and other labels than 0
    and 1 are not learned from."""
    one = labels.where(F.col(key).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(key).alias("__key")) \
        .agg(F.avg(F.col(label_col).cast("double")).alias("__y"))
    n = one.count()
    million = F.pmod(F.xxhash64(F.col("__key"), F.lit("mil")), F.lit(1_000_000))
    drawn = written(one.where(million < int(1_000_000 * min(1.0, rows / max(n, 1)))))
    text = F.col(text_col).cast("binary")
    picked = docs.select(F.col(key).alias("__key"), text.alias("__text")) \
        .join(broadcast_if_small(drawn, 24), "__key")
    picked = written(picked.dropDuplicates(["__key", "__text"])
                     .withColumn("order", F.xxhash64("__key", "__text")))
    found = picked.count()
    if found > 2 * rows:  # ids with many texts
        picked = picked.where(F.pmod(F.xxhash64("order"), F.lit(1_000_000)) < int(1_000_000 * rows / found))
    return written(map_texts(picked, "__text", ["order", "__y"], "bag binary",
                             lambda: lambda texts: [(bag(t).tobytes(),) for t in texts]).withColumnRenamed("__y", "y"))


def _pass_over(flat: np.ndarray, rate: float, k: int):
    """Round ``k`` of one shard, from the parameters ``flat``."""
    def shard(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["order", "y"])
        number = int(f["shard"].iat[0])
        bags = [np.frombuffer(v, np.uint16).reshape(-1, WIDTH) for v in f["bag"]]
        got = train_shard(AttentionModel.start().with_flat(flat), bags, f["y"].to_numpy(), rate, 1000 * k + number)
        return pd.DataFrame({"shard": [number], "n": [len(f)], "flat": [got.flat().astype("<f4").tobytes()]})
    return shard


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", key: str = "doc_id", text_col: str = "text",
        rows: int = FIT_ROWS, shards: int = SHARDS, rounds: int = FIT_ROUNDS) -> AttentionModel:
    """Learn from labelled texts; without any, every score is 0.5."""
    ship_package(docs.sparkSession)
    data = sample(docs, labels, label_col, key, text_col, rows) \
        .withColumn("shard", F.pmod(F.xxhash64("order", F.lit("shard")), F.lit(shards)).cast("int"))
    model = AttentionModel.start()
    for k in range(rounds):
        rate = float(RATE * 0.5 * (1 + np.cos(np.pi * k / rounds)))
        got = data.groupBy("shard").applyInPandas(_pass_over(model.flat(), rate, k), "shard int, n long, flat binary") \
            .collect()  # a model per shard
        if not got:
            break
        got.sort(key=lambda r: r["shard"])
        total = sum(r["n"] for r in got)
        model = model.with_flat(sum(np.frombuffer(r["flat"], "<f4").astype(np.float64) * (r["n"] / total) for r in got))
    return model


def score(df: DataFrame, model: AttentionModel, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``top_weight``, the attention weight
    of the passage that counts most.

    Null and empty texts and texts of white space are one empty passage.  Null ids
    stay, repeated rows repeat, an empty table gives an empty result; other columns
    aren't carried.  Texts of any length are read whole, slice by slice.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = df.select(*keep, F.col(text_col).cast("binary").alias("__bytes"))
    return map_texts(text, "__bytes", list(keep), "score double, top_weight double",
                     lambda: lambda texts: [shared.value.score(t) for t in texts])


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, mod 4, is 2 (null ids never train)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


@query("op13_quality_mil")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = fit(docs, labels)
    return score(docs, model, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "top_weight")
