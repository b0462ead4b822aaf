import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from exposcope.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, top):
    """Every score of every document, sorted: (item, rank, doc, score)."""
    have = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in have]
    n, total = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(t for _, c in have for t in c)
    want = {}
    for i, t in items:
        want.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in want.items():
        rows = []
        for (d, c), size in zip(have, sizes):
            if not size:
                continue
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, d is None, d if d is not None else 0, d))
        rows.sort(key=lambda r: r[:3])
        out += [(i, k + 1, r[3], -r[0]) for k, r in enumerate(rows[:top])]
    return out


def run(spark, docs, items, parts=5, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in ranking.search(d, i, **kw).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(n, seed, vocabulary=300):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)]
    weight = [1 / (k + 1) for k in range(vocabulary)]
    docs = [(k, " ".join(rng.choices(vocab, weight, k=rng.choice([0, 1, 3, 20, 80, 400])))) for k in range(n)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 30])))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("top,block", [(50, ranking.VOCABULARY_BYTES), (3, 2000), (1, 1)])
def test_equals_every_score(spark, top, block):
    """Ties (short texts repeat), all sizes of blocks and of results."""
    docs, items = corpus(700, top)
    assert order(run(spark, docs, items, top=top, block_bytes=block)) == order(brute(docs, items, top))


def test_whole_tables(spark, sf_small):
    d, i = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [tuple(r) for r in ranking.search(d, i).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in i.collect()], 50)
    assert order(got) == order(want)


def test_odd_rows(spark, odd):
    docs = odd("score")
    items = spark.createDataFrame([(1, "Ein text ID", "x"), (1, "two", "x"), (1, "two", "x"), (None, "É mixed 漢字", "x"), (2, None, "x"),
                                   (3, "", "x"), (4, "absent", "x"), (5, "satz " * 5000, "x")], "item_id long, text string, rank string")
    got = [tuple(r) for r in ranking.search(docs, items).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert order(got) == order(want) and {r[0] for r in got} == {1, None, 5}
    assert ranking.search(docs.where("false"), items).count() == 0
    assert ranking.search(docs, items.where("false")).count() == 0
    assert ranking.search(docs.where("text is null"), items).count() == 0


def test_null_ids_and_copies_rank_as_documents(spark):
    docs = [(7, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (None, "a b"), (9, "a b"), (1, "c c c c c c")]
    got = run(spark, docs, [(1, "A")], top=4)
    assert [r[2] for r in order(got)] == [3, 3, 7, 9]
    got = run(spark, docs, [(1, "A")], top=6)
    assert [r[2] for r in order(got)] == [3, 3, 7, 9, None, None]


def test_bounds_keep_all_that_count_and_drop_most():
    rng = np.random.default_rng(4)
    size, n = 400, 1500
    rows = [np.unique(rng.zipf(1.3, 40) % size) for _ in range(n)]
    impacts = [rng.integers(1, 10**6, len(r)) * (1 + r) for r in rows]
    lengths = np.array([math.sqrt((i.astype(float) ** 2).sum()) for i in impacts])
    by = np.argsort(-lengths)
    at = np.concatenate([[0], np.cumsum([len(rows[k]) for k in by])])
    bucket = ranking.Bucket(at, np.concatenate([rows[k] for k in by]), np.concatenate([impacts[k] for k in by]), lengths[by], size)
    kept = 0
    for _ in range(60):
        members = rng.choice(size, rng.integers(1, 30), replace=False)
        wanted = np.isin(np.arange(size), members)
        exact = bucket.scores(np.arange(n), wanted)
        assert exact.tolist() == [int(impacts[k][wanted[rows[k]]].sum()) for k in by]
        for least in (0, int(np.sort(exact)[-20]), int(exact.max()), int(exact.max()) + 1):
            got = bucket.survivors(members, float(least))
            must = np.flatnonzero((exact >= least) & (exact > 0))
            assert np.isin(must, got).all()
            kept += len(got) if least == np.sort(exact)[-20] else 0
    assert kept < 60 * n / 5


def test_terms_equal_pattern():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 .,[`{@/:\x7f\x00éÉ漢\U0001F600  \n") for _ in range(40))
        assert [w.decode() for w in ranking.terms(t.encode())] == words(t)
