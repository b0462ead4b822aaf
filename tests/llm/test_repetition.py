import re

from exposcope.llm import repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    at = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else None
    if at is None:
        from collections import Counter
        n = Counter(grams)
        at = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(at)


def coverage(text, n):
    words = WORD.findall(text or "")
    grams, seen, at = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)], set(), set()
    for i, g in enumerate(grams):
        if g in seen:
            at |= set(range(i, i + n))
        seen.add(g)
    return sum(len(words[i]) for i in at) / sum(map(len, words)) if words else 0.0


def test_query_equals_brute_force(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = R.op6(spark, sf_small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
        assert abs(r.cover_5 - coverage(texts[r.doc_id], 5)) < 1e-9 and abs(r.cover_10 - coverage(texts[r.doc_id], 10)) < 1e-9


def test_verdicts():
    clean = " ".join(f"w{i * 7919 % 1009}" for i in range(300))
    block = " ".join(f"b{i}" for i in range(40))
    assert R.measure(clean)[-1] == 0.0
    assert R.measure(clean + (" " + block) * 5)[7] > 0.15


def test_odd_rows(spark, odd):
    df = odd("n_words")
    rows = R.repetition(df).collect()
    assert len(rows) == 8
    none = [r for r in rows if r.doc_id in (1, 2, 5)]
    assert all(r.n_words == 0 and not r.repetitive for r in none)
    assert all(r.repetitive for r in rows if r.doc_id == 4)
    assert R.repetition(df.limit(0)).count() == 0
