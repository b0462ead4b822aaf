import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposcope.llm import codes


def brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS, scale=codes.SCALE):
    """Plain Lloyd rounds over (key, vector) rows, every distance of every round."""
    rows = [(k, [math.floor(scale * float(x)) for x in v]) for k, v in rows]
    seeds = sorted((r for r in rows if r[0] is not None))[:entries]
    x = np.array([v for _, v in rows], dtype=object).reshape(len(rows), parts, -1)
    book = np.array([v for _, v in seeds], dtype=object).reshape(len(seeds), parts, -1)

    def nearest():
        d = [[[sum((a - b) ** 2 for a, b in zip(r[p], c[p])) for c in book] for p in range(parts)] for r in x]
        return [[min(range(len(book)), key=lambda e: (q[e], e)) for q in r] for r in d], d

    for _ in range(rounds):
        mine, _d = nearest()
        for p in range(parts):
            for e in range(len(book)):
                got = [x[r][p] for r in range(len(x)) if mine[r][p] == e]
                if got:
                    book[e][p] = [sum(g[j] for g in got) // len(got) for j in range(len(got[0]))]
    mine, d = nearest()
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(book)) for v in book[e][p]).encode()).hexdigest()
    return sorted((-1 if k is None else k, bytes(m).hex(), sum(d[r][p][m[p]] for p in range(parts)))
                  for r, ((k, _), m) in enumerate(zip(rows, mine))), digest


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, None) for k, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = codes.compress(df, **kw)
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"]) for r in got.codes.collect()), got


@pytest.mark.parametrize("n,dim,spread", [(400, 16, 1.0), (300, 8, 0.002), (9, 24, 1.0), (1, 8, 1.0), (300, 16, 3000.0)])
def test_equals_plain_rounds(spark, n, dim, spread):
    rng = np.random.default_rng(n + dim)
    centre = rng.normal(size=(20, dim))
    rows = [(int(k), (spread * (centre[k % 20] + 0.4 * rng.normal(size=dim))).tolist()) for k in rng.permutation(n)]
    want, digest = brute(rows)
    got, books = run(spark, rows)
    assert got == want
    assert books.digest == digest


def test_ties_repeats_and_null_keys(spark):
    """Integer grid: many equal distances; repeated rows and keys, rows without key."""
    rng = np.random.default_rng(3)
    rows = [(int(k) // 2, (rng.integers(-2, 3, 8) / codes.SCALE).tolist()) for k in range(200)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, [0.0] * 8)]
    want, digest = brute(rows)
    got, books = run(spark, rows)
    assert got == want and books.digest == digest


def test_other_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=12).tolist()) for k in range(150)]
    want, digest = brute(rows, parts=3, entries=40, rounds=4, scale=100)
    got, books = run(spark, rows, parts=3, entries=40, rounds=4, scale=100)
    assert got == want and books.digest == digest


def test_bounds_save_work_and_b_adapts(spark):
    rng = np.random.default_rng(1)
    centre = 5 * rng.normal(size=(16, 16))
    rows = [(k, (centre[k % 16] + 0.1 * rng.normal(size=16)).tolist()) for k in range(320)]
    _, books = run(spark, rows)
    assert books.widths[0] == 4 and books.widths[-1] == 2 and books.widths == sorted(books.widths, reverse=True)


def test_odd_rows(spark):
    """Null, empty, short, NaN and infinite vectors go; labels may be null; clashing columns are not carried."""
    good = [(k, [k / 10.0] * 8, k % 2 if k % 3 else None, "x", b"y") for k in range(30)]
    bad = [(90, None, 1, "x", b"y"), (91, [], 1, "x", b"y"), (92, [1.0] * 7, 1, "x", b"y"), (93, [1.0] * 16, 1, "x", b"y"),
           (94, [float("nan")] + [0.0] * 7, 1, "x", b"y"), (95, [float("-inf")] + [0.0] * 7, 1, "x", b"y"), (96, [None] + [0.0] * 7, 1, "x", b"y")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int, __x string, error binary")
    books = codes.compress(df)
    out = codes.label_errors(books.codes)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] or set(out.columns) == {"vec_id", "label", "code", "error", "label_error"}
    rows = out.collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(30))
    for r in rows:
        assert r["label_error"] == sum(q["error"] for q in rows if q["label"] == r["label"])
    empty = codes.compress(df.where("vec_id < 0"))
    assert codes.label_errors(empty.codes).count() == 0 and empty.digest == hashlib.sha256(b"").hexdigest()
    assert codes.compress(df.where("vec_id > 89").where("vec_id < 92")).codes.count() == 0


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        codes.compress(df)


def test_old_states_are_removed(spark, sf_small):
    import os
    from exposcope.session import checkpoint_dir
    from urllib.parse import urlparse
    folder = urlparse(checkpoint_dir(spark)).path + "/tables"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    codes.compress(spark.read.parquet(f"{sf_small}/embeddings.parquet")).codes.agg(F.sum("error")).collect()
    assert len(set(os.listdir(folder)) - before) == 1
