import zlib

import numpy as np

from exposcope.llm import langid as L


def test_held_out_accuracy(spark):
    rows = L.op7(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_ignores_labels_of_held_out_rows(spark, sf_small):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("held_out", L.held_out())
    a = L.fit(docs.where("NOT held_out"))
    b = L.fit(docs.withColumn("lang", F.when(F.col("held_out"), F.lit("xx")).otherwise(F.col("lang"))).where("NOT held_out"))
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids)


def test_counts_cover_the_whole_text():
    assert L.counts(None) is None and L.counts("12 - !") is None
    assert L.counts("ab").sum() == 4 + 3 + 2
    assert (L.counts("x" * 50_000 + " ñandú") - L.counts("x" * 50_000)).max() > 0


def test_odd_rows_and_no_training_rows(spark, odd):
    df = odd("score")
    model = L.fit(df)
    rows = {r.doc_id: r for r in L.predict(df, model).collect()}
    assert rows[2].lang_pred == rows[1].lang_pred == rows[5].lang_pred == "und" and rows[5].rejected
    assert rows[4].lang_pred == "de"
    assert L.predict(df.limit(0), model).count() == 0
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}


def test_far_texts_are_rejected(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = L.fit(docs)
    got = model.predict(["Съешь ещё этих мягких французских булок да выпей чаю " * 5, docs.first().text])
    assert got[0][2] and not got[1][2]
