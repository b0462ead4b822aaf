import random

import xxhash
from hypothesis import given, settings, strategies as st

from exposcope.llm import spans as S

TEXT = st.text(st.sampled_from("ab. \n!?"), max_size=80)


def sent(n, seed):
    r = random.Random(seed)
    return " ".join(f"s{r.randrange(10 ** 6)}" for _ in range(n)).capitalize() + "."


def plain_sentences(text):
    """Word lists, character by character and window by window."""
    pieces, piece = [], ""
    for k, c in enumerate(text):
        piece += c
        after = text[k + 1:k + 2]
        if c == "\n" or after.isspace() and piece.rstrip("\"')]»”")[-1:] in tuple(".!?"):
            pieces.append(piece)
            piece = ""
    out = []
    for p in (*pieces, piece):
        words = p.split()
        ends = set()
        if len(words) > S.LONG_SENTENCE:
            for k in range(len(words) - S.WINDOW + 1):
                ends.add(min(range(k, k + S.WINDOW), key=lambda j: (xxhash.xxh3_64_intdigest(words[j]), -j)))
        at = 0
        for e in sorted(ends | {len(words) - 1}):
            if words[at:e + 1]:
                out.append(words[at:e + 1])
            at = e + 1
    return out


def brute(rows):
    """Every run as a tuple of sentences; what to drop per row."""
    places = {}
    for d, t in rows:
        u = [(None, None, w) for w in plain_sentences(t or "")]
        size = [len(x[2]) for x in u]
        mine = set()
        for i in range(len(u)):
            for j in range(i + S.MIN_SENTENCES - 1, len(u)):
                if sum(size[i:j + 1]) >= S.MIN_WORDS:
                    mine.add((i, j))
                    break
        for j in range(len(u)):
            for i in range(j - S.MIN_SENTENCES + 1, -1, -1):
                if sum(size[i:j + 1]) >= S.MIN_WORDS:
                    mine.add((i, j))
                    break
        for i, j in mine:
            places.setdefault(tuple(" ".join(x[2]) for x in u[i:j + 1]), set()).add((d, i, j))
    gone = {}
    for p in places.values():
        first = min((d, i) for d, i, _ in p)
        for d, i, j in p:
            if (d, i) != first:
                gone.setdefault(d, set()).update(range(i, j + 1))
    return gone


def check(got, rows):
    gone = brute(rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows)):
        assert r.doc_id == d and r.n_removed == len(gone.get(d, ()))
        want = [w for k, w in enumerate(plain_sentences(t or "")) if k not in gone.get(d, ())]
        assert (r.text or "").split() == [x for w in want for x in w]
        if d not in gone:
            assert r.text == t


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(S.op10(spark, sf_small).collect(), rows)


def test_repeated_passage_goes_but_for_its_first_place(spark):
    passage = " ".join(sent(n, n) for n in (9, 14, 11, 12, 8))
    long_one = sent(70, 99)
    rows = [(i, f"{sent(30, 10 * i)} {passage} {sent(12, 10 * i + 1)}\n{long_one}") for i in range(1, 8)]
    rows += [(9, passage + " " + passage), (0, " ".join(sent(12, 500 + k) for k in range(6)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeated_spans(df).collect()}
    check(got.values(), rows)
    assert got[1].text == rows[0][1] and got[0].text == rows[-1][1]
    for i in range(2, 8):
        assert passage not in got[i].text and sent(14, 14) not in got[i].text and sent(8, 8) not in got[i].text
        assert len(got[i].text.split()) < 30 + 12 + 50
    assert got[9].text.count("S") < 5


def test_shuffled_joins_give_the_same(spark, sf_small):
    want = sorted(map(tuple, S.op10(spark, sf_small).collect()))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        assert sorted(map(tuple, S.op10(spark, sf_small).collect())) == want
    finally:
        for n in names:
            spark.conf.unset(n)


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_sentences_partition_the_text(t):
    u = S.sentences(t)
    assert [x[2] for x in u] == plain_sentences(t)
    assert sum((x[2] for x in u), []) == t.split()
    assert all(a[1] <= b[0] for a, b in zip(u, u[1:]))


def test_passages_without_ends_are_always_found():
    r = random.Random(5)
    size = S.MIN_WORDS + 4 * S.WINDOW - 4
    for vocabulary in (20_000, 5, 1):
        def prose(n):
            return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
        for _ in range(200):
            passage = prose(size)
            a, b = (S.runs(f"{prose(r.randrange(30))} {passage} {prose(r.randrange(30))}") for _ in range(2))
            assert set(zip(a[0].tolist(), a[1].tolist())) & set(zip(b[0].tolist(), b[1].tolist()))


def test_odd_rows(spark, odd):
    df = odd("h1")
    got = S.remove_repeated_spans(df)
    assert sorted(got.columns) == sorted([*df.columns, "n_removed"])
    rows = got.collect()
    assert len(rows) == 8 and {r.doc_id: r.text for r in rows}[2] is None
    assert all(r.n_removed > 3900 for r in rows if r.doc_id == 4)  # the row twice: one document
    assert S.remove_repeated_spans(df.limit(0)).count() == 0
