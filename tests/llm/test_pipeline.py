import hashlib
import re
import struct
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline as C
from exposcope.llm import boilerplate, bpe, toxicity
from test_neardup import brute as components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def steps(spark, sf_small, tmp_path_factory):
    """What each stage got and returned, written and read between stages."""
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf_small).write.parquet(path)
        result = spark.read.parquet(path)
        if k + 1 < len(C.STAGES):
            assert result.columns == columns
        out.append((docs.collect(), result.collect()))
        docs = result
    return out


def test_toxic_documents_go_and_no_others(spark, steps, sf_small):
    before, after = steps[0]
    model = toxicity.fit_chain(spark.createDataFrame(before), spark.read.parquet(f"{sf_small}/labels.parquet"))
    want = [r for r in before if model.probabilities(r.text)[1] < toxicity.THRESHOLD]
    assert sorted(map(tuple, after)) == sorted(map(tuple, want))


def test_boilerplate_lines_go(steps):
    before, after = steps[1]
    pages, holding = defaultdict(set), defaultdict(set)
    for r in before:
        pages[r.source].add(r.text)
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                holding[r.source, line.strip(" ")].add(r.text)
    bad = {k for k, v in holding.items() if len(v) >= boilerplate.MIN_PAGES and len(v) > boilerplate.RATIO * len(pages[k[0]])}
    want = {}
    for r in before:
        lines = r.text.split("\n")
        kept = [x for x in lines if (r.source, x.strip(" ")) not in bad]
        text = "\n".join(kept)
        want[r.doc_id] = (text, len(text) if len(kept) < len(lines) else r.n_chars)
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == want and bad


def test_one_document_of_each_group_stays(steps):
    before, after = steps[2]
    groups = components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})


def test_contaminated_documents_go(spark, steps, sf_small):
    before, after = steps[3]
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[len(w[i:i + 13])].add(tuple(w[i:i + 13]))
    want = []
    for r in before:
        w = words(r.text)
        hit = {p for n, ws in windows.items() for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in ws for p in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(want) and len(want) < len(before)


def test_tokens(steps):
    before, after = steps[4]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=bpe.parse_ranks(
        open(P.path("byte_bpe_50k.tiktoken"), "rb").read()))
    want = {}
    for r in before:
        ids = lib.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after} == want


def test_run_is_the_registered_query(spark, steps, sf_small):
    rows = __spark_entry__.queries()["pipeline"](spark, sf_small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, steps[-1][1]))
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_odd_rows_pass_every_stage(spark, odd, sf_small):
    docs = odd("__row")
    for name, stage in C.STAGES:
        got = stage(spark, docs, sf_small)
        ids = [r.doc_id for r in got.collect()]
        assert {1, 2, 3, 5, 6, None} <= set(ids), name
        assert stage(spark, docs.limit(0), sf_small).count() == 0
    assert C.drop_copies(spark, docs, sf_small).columns == docs.columns


def test_queries_are_registered():
    have = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in have) for k in range(1, 11)) and "pipeline" in have
