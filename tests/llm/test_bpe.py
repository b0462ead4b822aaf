import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from exposcope.llm import bpe

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = bpe.parse_ranks(DATA)
OWN = bpe.PrefixBPE(RANKS, P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})

texts = st.text(st.one_of(st.sampled_from("ab'stlrev  \n\té1ñ."), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=60)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=150, deadline=None)
@given(texts)
def test_equals_the_library(t):
    assert ids(OWN.encode(t)) == LIB.encode_ordinary(t)
    assert OWN.decode(OWN.encode(t)) == t.encode()


@pytest.mark.parametrize("t", ["", " " * 5000, "a" * 3000, "The quick\r\n\r\n  fox's ", "　 x", "<|endoftext|>", "é" * 999])
def test_odd_texts(t):
    assert ids(OWN.encode(t)) == LIB.encode_ordinary(t)


@settings(max_examples=100, deadline=None)
@given(texts, texts, st.data())
def test_appends_and_edits_are_exact(a, b, data):
    e = bpe.EncodedText(OWN, a)
    e.append(b)
    assert e.text == a + b and e.ids() == LIB.encode_ordinary(a + b)
    i = data.draw(st.integers(0, len(a + b)))
    j = data.draw(st.integers(i, len(a + b)))
    e.replace(i, j, a)
    assert e.text == (a + b)[:i] + a + (a + b)[j:] and e.ids() == LIB.encode_ordinary(e.text)


def test_an_edit_in_a_long_piece_recomputes_little():
    t = "x" + "abcdefgh" * 500
    e = bpe.EncodedText(OWN, t)
    e.replace(2000, 2001, "q")
    assert e.ids() == LIB.encode_ordinary(e.text) and 0 < e.recomputed < 2000


def test_operator_on_odd_rows(spark):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, None), (None, "é\n", "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    v = bpe.load_vocabulary(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    coded = bpe.encode_texts(df, v)
    assert coded.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id, ids(r.ids)) for r in coded.collect()), key=str)
    assert got == sorted(((k, LIB.encode_ordinary(t or "")) for k, t, _ in rows), key=str)
    back = bpe.decode_ids(coded, v).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(df.limit(0), v).count() == 0


def test_query_equals_the_library_on_whole_texts(spark, sf_small):
    got = {r.doc_id: r for r in bpe.op1(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = LIB.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_pairs_survive_as_merging_says():
    import random
    r, ids_ = random.Random(3), sorted(OWN.ends)
    pairs = [(r.choice(ids_), r.choice(ids_)) for _ in range(20_000)] + [(a, a) for a in ids_[::7]]
    near = [i for i in ids_ if len(OWN.bytes_of[i]) < 4]
    pairs += [(r.choice(near), r.choice(near)) for _ in range(20_000)]
    for a, b in pairs:
        assert OWN.compatible(a, b) == (OWN.merge(OWN.bytes_of[a] + OWN.bytes_of[b]) == [a, b])
