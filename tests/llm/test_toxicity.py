from exposcope.llm import toxicity as T


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit_chain(docs, labels.where("doc_id % 4 <> 0"))
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 0").collect()}
    p = {r.doc_id: r.p_toxic for r in T.score(docs, model).collect()}
    assert len(p) == docs.count()
    hit = [p[d] >= T.THRESHOLD for d, t in truth.items() if t]
    false = [p[d] >= T.THRESHOLD for d, t in truth.items() if not t]
    assert sum(hit) / len(hit) > 0.7 and sum(false) / len(false) < 0.02


def test_later_models_use_earlier_probabilities():
    m = T.ChainModel([T.LinkModel("a", {"bad": 9.0}, [], -4.0), T.LinkModel("b", {}, [1.0], -1.0)])
    assert m.probabilities("bad")[1] > 0.9 > 0.1 > m.probabilities("fine")[1]


def test_query_returns_every_document(spark, sf_small):
    rows = T.op8(spark, sf_small).collect()
    assert len(rows) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert all(r.toxic == (r.p_toxic >= T.THRESHOLD) != r.kept for r in rows)


def test_odd_rows_and_few_labels(spark, odd):
    df = odd("tokens")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit_chain(df, none)
    assert all(r.p_toxic < 0.01 for r in T.score(df, model).collect())
    one = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = T.fit_chain(df, one)
    rows = T.score(df, model).collect()
    assert len(rows) == 8 and all(r.p_toxic < 0.01 for r in rows)
    assert T.score(df.limit(0), model).count() == 0


def test_draw_is_bounded(spark):
    labels = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert 700 < T.draw(labels, "doc_id", 1000).count() < 1300
    assert T.draw(labels, "doc_id", 5000).count() == 5000
