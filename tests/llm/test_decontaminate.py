import pytest
from pyspark.sql import functions as F

from exposcope.llm import decontaminate as D


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hits string")


PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def test_windows_hits_and_share(spark):
    texts = [PHRASE.upper() + "!", "pre, " + PHRASE + " post" * 300, PHRASE[:-3], "", None, "---",
             "-" + PHRASE, "short item here", "x " * 30 + "É short-item HERE"]
    got = {r.doc_id: r for r in D.contamination(docs(spark, texts), items(spark, [
        (7, PHRASE), (10, PHRASE + " xi"), (9, "Short item, here"), (1, ""), (2, None), (7, PHRASE)])).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (13, 13, 2, True)  # 10's first window
    assert (got[1].n_hit, got[1].contaminated) == (13, False)
    assert [got[k].n_hit for k in (2, 3, 4, 5)] == [0, 0, 0, 0] and [got[k].n_words for k in (2, 3, 4, 5)] == [12, 0, 0, 0]
    assert got[6].n_hit == 13 and got[7].n_hit == 3 and got[8].n_hit == 3 and got[8].contaminated
    assert got[0].hits == "x"


def test_only_ascii_letters_fold(spark):
    got = D.contamination(docs(spark, ["École été", "école été"]), items(spark, [(1, "école été")])).collect()
    assert {r.doc_id: r.n_hit for r in got} == {0: 0, 1: 2}


def test_copies_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, PHRASE, 5), (1, PHRASE, 5), (None, PHRASE, 6), (2, PHRASE, 7)], "doc_id long, text string, key long")
    got = D.contamination(df, items(spark, [(3, PHRASE)])).collect()
    assert len(got) == 4 and all(r.n_hit == 13 for r in got) and sorted(r.key for r in got) == [5, 5, 6, 7]


def test_empty_tables_and_odd_rows(spark, odd):
    none = items(spark, [])
    assert D.contamination(odd("key"), none).where("contaminated").count() == 0
    assert D.contamination(odd("n_hit").limit(0), items(spark, [(1, PHRASE)])).count() == 0
    assert D.contamination(odd("start"), items(spark, [(1, "Ein Satz")])).where("contaminated").count() == 2


def test_shuffled_joins_give_the_same(spark, sf_small, monkeypatch):
    want = sorted(map(tuple, D.op4(spark, sf_small).collect()))
    monkeypatch.setattr(D, "broadcast_if_small", lambda df, *_: df)
    assert sorted(map(tuple, D.op4(spark, sf_small).collect())) == want


def test_proximity_equals_brute_force(spark):
    texts = ["alpha one two beta three gamma", "gamma beta alpha", "alpha " + "z " * 30 + "beta gamma", "alpha beta"]
    df = docs(spark, texts)
    got = D.proximity_matches(D.keyed(df), items(spark, [(1, "alpha beta gamma")]), slop=6).join(
        df.select("doc_id", F.md5("text").alias("key")), "key").collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(0, 0, 5), (1, 0, 2)]


def test_proximity_of_items_with_few_held_words(spark):
    df = docs(spark, ["alpha one beta", "beta " + "z " * 30 + "alpha", "gamma", "none"])
    got = D.proximity_matches(D.keyed(df), items(spark, [(1, "alpha beta unheard"), (2, "Gamma"), (3, "unheard"), (4, "")]), slop=6).join(
        df.select("doc_id", F.md5("text").alias("key")), "key").collect()
    assert sorted((r.doc_id, r.item, r.start, r.end) for r in got) == [(0, 1, 0, 2), (2, 2, 0, 0)]


def test_proximity_query_equals_brute_force(spark, sf_small):
    import collections
    import re
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]
    texts = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    n = collections.Counter(w for t in texts.values() for w in t)
    item = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect():
        item[r.item_id] |= {w for w in words(r.text) if n[w]}
    rare = {i: sorted(ws, key=lambda w: (n[w], w))[:D.LISTS] for i, ws in item.items() if ws}
    want = {}
    for d, t in texts.items():
        at = collections.defaultdict(list)
        for p, w in enumerate(t):
            at[w].append(p)
        near = lambda ws: any(all(any(s <= p < s + 20 for p in at.get(w, ())) for w in ws)
                              for x in ws for s in at.get(x, ()))
        want[d] = sum(near(ws) for ws in rare.values() if all(w in at for w in ws))
    assert {r.doc_id: r.n_near for r in D.op4_proximity(spark, sf_small).collect()} == want and any(want.values())
