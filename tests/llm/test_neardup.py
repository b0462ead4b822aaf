import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from exposcope.llm import components, neardup as N

rnd = random.Random(5)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10 ** 6)}" for _ in range(n)]


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(got, rows):
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(N.op3(spark, sf_small).collect(), rows)


def planted():
    """Chains, exact copies, a hot near-copy group, a shared passage, texts near the threshold."""
    rows, passage = [], words(40, 1)
    base = words(120, 2)
    for i in range(90):  # near copies of one text, some of them only near each other
        w = list(base)
        for k in random.Random(i).sample(range(120), i % 7):
            w[k] = f"x{i}_{k}"
        rows.append(" ".join(w))
    rows += [" ".join(words(60, 100 + i) + passage) for i in range(60)]
    chain = words(200, 3)
    for i in range(12):  # each near the next only
        rows.append(" ".join(chain))
        for k in range(i * 5, i * 5 + 5):
            chain[k * 3] = f"c{i}_{k}"
    rows += [" ".join(words(30, 4))] * 40 + ["same few", "SAME few", "", "a b c d e"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [64, 8])
def test_planted_groups(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)  # 8: large buckets go the blockwise way
    rows = planted()
    check(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(N, "broadcast_if_small", lambda df, *_: df)
    monkeypatch.setattr(components, "broadcast_if_small", lambda df, *_: df)
    check(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_posterior_bounds():
    assert all(N.least_matches(n) / n < 0.75 for n in N.BATCHES)
    r = np.random.default_rng(0)
    near = (r.random((4000, N.VALUES)) < 0.75).astype(np.uint16)
    ones, n = np.ones_like(near), np.full(4000, 100)
    assert len(N.survivors(n, near, n, ones)) == 4000
    far = (r.random((4000, N.VALUES)) < 0.3).astype(np.uint16)
    assert len(N.survivors(n, far, n, ones)) == 0


def test_components_equal_union_find(spark):
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd):
    df = odd("node")
    rows = N.near_duplicates(df).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[5].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[None].component_id is None and by[None].kept and by[None].n_shingles > 0
    assert [r.kept for r in rows if r.doc_id == 4] == [True, True] and by[4].n_shingles == 2
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components_of_an_ascending_chain(spark, monkeypatch):
    """5,000 nodes whose ids ascend along a chain, in few rounds."""
    rounds = []
    plain = components._rooted
    monkeypatch.setattr(components, "_rooted", lambda up: (rounds.append(1), plain(up))[1])
    edges = spark.range(4999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(4)
    got = components.connected_components(edges)
    assert got.count() == 5000 and got.where("component <> 0").count() == 0 and len(rounds) <= 20
    rounds.clear()  # ids up and down, and a star whose centre is the greatest
    zigzag = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(10000 - F.col("id")).alias("a"),
                                      F.when(F.col("id") % 2 == 1, F.col("id") + 1).otherwise(9999 - F.col("id")).alias("b"))
    star = spark.range(500).select((F.col("id") + 20000).alias("a"), F.lit(99999).alias("b"))
    got = components.connected_components(zigzag.unionByName(star))
    assert {r["component"] for r in got.collect()} == {0, 20000} and len(rounds) <= 20
