from pyspark.sql import functions as F

from exposcope.llm import boilerplate as B


LINES = B.split_lines


def apply(df, **more):
    """Equal texts of a source counted as one page."""
    return by(df, B.content(LINES(F.col("text"))), **more)


def by(df, page, **more):
    return B.drop_boilerplate(df, F.col("source"), LINES(F.col("text")), page=page, **more)


def pages(spark, n=40):
    rows = [(i, f"Top menu\nOwn line {i}\n\nshared by site\n", "en", "s1", 1) for i in range(n)]
    rows += [(1000 + i, f"Top menu\nother {i}", "en", "s2", 1) for i in range(2)]
    rows += [(2000 + i, "Copy line a\nCopy line b", "en", "s1", 1) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_drops_the_site_s_lines_only(spark):
    got = {r.doc_id: r for r in apply(pages(spark)).collect()}
    assert got[3].text == "Own line 3\n\n" and got[3].n_dropped == 2 and got[3].n_lines == 5
    assert got[1000].text == "Top menu\nother 0"  # too few pages of that site
    assert got[2000].text == "Copy line a\nCopy line b"  # copies are one page


def test_salted_join_gives_the_same(spark, monkeypatch):
    want = sorted(map(tuple, apply(pages(spark)).collect()))
    monkeypatch.setattr(B, "broadcast_if_small", lambda df, *_: df)
    assert sorted(map(tuple, apply(pages(spark)).collect())) == want


def test_hosts():
    assert "@" not in B.BREAKS


def test_odd_rows(spark, odd):
    df = odd("__bad")
    got = apply(df)
    assert sorted(got.columns) == sorted([*df.columns, "n_lines", "n_dropped"])
    rows = got.collect()
    assert len(rows) == 8
    assert {r.doc_id: r.text for r in rows}[2] is None
    assert {r.doc_id: r.text for r in rows}[6] == "éèê ñ ß 漢字 \U0001F600 mixed\r\nline"
    assert apply(df.limit(0)).count() == 0


def brute(rows, ids):
    """(doc_id, text) -> kept lines, by plain counting of (host, page) sets."""
    pages_of, holding = {}, {}
    for (doc_id, text, _, host, _), page in zip(rows, ids):
        if text is None:
            continue
        pages_of.setdefault(host, set()).add(page)
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            holding.setdefault((host, line), set()).add(page)
    bad = {k for k, v in holding.items() if len(v) >= B.MIN_PAGES and len(v) > B.RATIO * len(pages_of[k[0]])}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (host, x.strip(" ")) not in bad)
            for _, t, _, host, _ in rows]


def test_pages_are_told_apart_by_id(spark):
    """Copies with ids of their own are pages; rows that repeat an id, null too, are one."""
    df = pages(spark)
    got = {r.doc_id: r.text for r in by(df, F.col("doc_id")).collect()}
    assert got[2000] == "" and got[3] == "Own line 3\n\n"  # 30 of 70 pages hold the copies' lines
    rows = [tuple(r) for r in df.collect()]
    rows += [(None, "Null menu\nx", "en", "s3", 1)] * 5 + [(7000, "Twice\ny", "en", "s3", 1)] * 5
    rows += [(7001 + i, f"z{i}", "en", "s3", 1) for i in range(3)] + [(7100, None, "en", "s3", 1), (7101, "a", "en", None, 1)]
    more = spark.createDataFrame(rows, df.schema)
    text = sorted((r.doc_id is None, r.doc_id, r.text or "~") for r in by(more, F.col("doc_id")).collect())
    assert text == sorted((r[0] is None, r[0], t or "~") for r, t in zip(rows, brute(rows, [r[0] for r in rows])))
    # every row a page
    text = sorted((r.doc_id is None, r.doc_id, r.text or "~") for r in by(more, None).collect())
    assert text == sorted((r[0] is None, r[0], t or "~") for r, t in zip(rows, brute(rows, range(len(rows)))))
    assert not any("Null menu" in t or "Twice" in t for _, _, t in text)
