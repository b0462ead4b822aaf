import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposcope.llm import mil


def brute_counts(text: bytes):
    """Passages of one slice, byte by byte."""
    units = []  # (start, end) of words, long runs in pieces; blanks go with the word before
    for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text):
        units += [(m.start() + k, min(m.start() + k + mil.RUN, m.end())) for k in range(0, m.end() - m.start(), mil.RUN)]
    out, seen = [], set()
    for k in range(0, len(units), mil.PASSAGE):
        some = units[k:k + mil.PASSAGE]
        lo = 0 if k == 0 else some[0][0]
        hi = units[k + mil.PASSAGE][0] if k + mil.PASSAGE < len(units) else len(text)
        part = text[lo:hi]
        words = [text[a:b].translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for a, b in some]
        own = len(set(words))
        new = len(set(words) - seen)
        seen |= set(words)
        symbols = sum(33 <= c < 127 and not chr(c).isalnum() for c in part)
        out.append(([part.count(bytes([c])) for c in range(256)],
                    [sum(65 <= c <= 90 for c in part) / len(part), sum(48 <= c <= 57 for c in part) / len(part), symbols / len(part),
                     own / len(words), new / len(words), len(part) / len(words) / (mil.RUN + 1)]))
    return out


@pytest.mark.parametrize("text", [b"One two one.\nTWO && 3 ", b"  " + b"abc " * 200, b"x" * 5000, "é漢 ß\n".encode() * 90, b"a", b" \n", b""])
def test_counts_equal_brute_force(text):
    got, want = mil.passages(text), brute_counts(text)
    assert len(got) == len(want)
    for g, (counts, figures) in zip(got, want):
        assert g[:256].tolist() == counts
        assert g[256:256 + mil.PAIRS].sum() in (sum(counts), sum(counts) - 1)
        assert np.allclose(g[256 + mil.PAIRS:] / 1000, np.minimum(figures, 10), atol=6e-4)


def direct(model, text):
    """Score by one softmax over all passages."""
    x = [p for s in mil.slices(text) for p in mil.passages(s)] or [np.zeros(mil.WIDTH, np.uint16)]
    h, e = model.encode(mil.scaled(np.stack(x)))
    a = np.exp(e - e.max())
    return 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.c + model.d[0]))), a.max() / a.sum()


def random_model(seed):
    m = mil.AttentionModel.start(seed)
    r = np.random.default_rng(seed)
    return m.with_flat(m.flat() + 0.3 * r.normal(size=m.flat().size))


def test_score_over_slices_equals_one_softmax(monkeypatch):
    monkeypatch.setattr(mil, "SLICE_BYTES", 3000)
    m = random_model(2)
    r = np.random.default_rng(0)
    for n in (0, 1, 50, 3000):
        text = " ".join("".join(chr(c) for c in r.integers(60, 120, r.integers(1, 12))) for _ in range(n)).encode()
        assert b"".join(mil.slices(text)) == text
        assert np.allclose(m.score(text), direct(m, text), atol=1e-5)


def test_gradients_equal_differences():
    m = random_model(5)
    r = np.random.default_rng(1)
    x = r.random((9, mil.WIDTH)).astype(np.float32) / 10
    starts, y = np.array([0, 1, 5]), np.array([1, 0, 0.5], np.float32)

    def loss(flat):
        k = m.with_flat(flat)
        for n in k.NAMES:
            setattr(k, n, getattr(k, n).astype(np.float64))
        out = 0
        for lo, hi, t in zip(starts, [1, 5, 9], y):
            h, e = k.encode(x[lo:hi].astype(np.float64))
            a = np.exp(e) / np.exp(e).sum()
            p = 1 / (1 + np.exp(-(a @ h @ k.c + k.d[0])))
            out -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return out / 3

    got = np.concatenate([g.ravel() for g in m.gradients(x, starts, y)])
    flat = m.flat().astype(np.float64)
    for k in [*r.integers(0, flat.size, 40), *range(flat.size - 60, flat.size)]:
        step = np.zeros(flat.size)
        step[k] = 1e-2
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-2 - got[k]) < 2e-3 * max(1, abs(got[k]))


def test_held_out_quality(spark):
    """Unseen texts of sf0.01: nearly all pairs of a good and a bad text in order."""
    d = "/root/testdata/sf0.01"
    out = mil.op13(spark, d)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [[r["score"] for r in rows if r["quality"] == q] for q in (1, 0)]
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_attention_finds_the_passage_that_decides():
    """Long good texts with one bad passage are bad: the weight goes to that passage."""
    r = np.random.default_rng(3)
    word = lambda a: "".join(chr(97 + c) for c in r.integers(0, 12, 5)) + a
    bags, y = [], []
    for k in range(300):
        parts = [" ".join(word("") for _ in range(64)) for _ in range(6)]
        if k % 2:
            parts[r.integers(0, 6)] = " ".join(word("###") for _ in range(64))
        bags.append(mil.bag(" ".join(parts).encode()))
        y.append(1.0 - k % 2)
    m = mil.AttentionModel.start()
    for k in range(4):
        m = mil.train_shard(m, bags[:240], np.array(y[:240]), 0.01, k)
    scores = []
    for b in bags[240:]:
        h, e = m.encode(mil.scaled(b))
        a = np.exp(e - e.max())
        a /= a.sum()
        scores.append(1 / (1 + np.exp(-(a @ h @ m.c + m.d[0]))))
        if b[:, ord("#")].any():
            assert a[b[:, ord("#")].argmax()] > 0.5
    assert np.mean((np.array(scores) > 0.5) == np.array(y[240:])) > 0.95


def test_odd_rows(spark, odd):
    docs = odd("score")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (4, 1, "x"), (4, None, "x"), (5, 0, "x"), (6, 7, "x"), (99, 1, "x")],
                                   "doc_id long, quality int, bag string")
    picked = mil.sample(docs, labels, "quality", "doc_id", "text", 100).collect()
    assert sorted(r["y"] for r in picked) == [0.0, 0.5, 1.0]  # ids 5, 1, 4 (its copies once)
    model = mil.fit(docs, labels, rounds=1)
    out = mil.score(docs, model)
    assert out.columns == ["doc_id", "score", "top_weight"] and out.count() == docs.count()
    by = {r["doc_id"]: r["score"] for r in out.collect()}
    assert by[1] == by[2] == by[5] and all(0 <= s <= 1 for s in by.values())
    assert mil.score(docs.where("false"), model).count() == 0
    for none in (labels.where("false"), labels.where("quality = 7")):
        flat = mil.score(docs, mil.fit(docs, none))
        assert {r["score"] for r in flat.collect()} == {0.5}
    assert mil.score(docs, mil.fit(docs.where("false"), labels)).select(F.min("score")).first()[0] == 0.5


def test_ids_with_many_texts_stay_within_the_bound(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert mil.sample(docs, labels, "quality", "doc_id", "text", 200).count() < 400
