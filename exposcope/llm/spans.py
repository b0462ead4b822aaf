"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences that just reaches MIN_WORDS words is hashed
(128 bits), from each sentence forwards and to each sentence backwards.  Runs
are joined over the whole corpus; the first occurrence of a run (smallest
doc_id, then position) stays, and sentences that any later occurrence covers
are removed.  A repeated passage is so covered up to its last whole sentence.

A sentence ends at its terminator or line end.  Only a stretch of more than
LONG_SENTENCE words without any end is cut further, at local minima of its word
hashes: in every WINDOW consecutive words the rightmost smallest one ends a unit,
so the same passage is cut alike wherever it stands, but for WINDOW - 1 words at
its ends.  A repeated passage of MIN_WORDS + 4 * WINDOW - 4 words or more that
holds no end is therefore always found, if each place's stretch is long.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import discard, explode_values, map_texts, table, written

#: A run has this many words and sentences at least, and no more than it needs to.
MIN_WORDS, MIN_SENTENCES = 30, 2
#: Stretches of more words without an end are cut, once at least in WINDOW words.
LONG_SENTENCE, WINDOW = 40, 6

END = re.compile(r"""[.!?]+["')\]»”]*(?=\s)|\n""")
WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=50_000)
def _short_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _word_hash(word: str) -> int:
    # only short words are kept, so the cache is bounded in bytes too
    return _short_hash(word) if len(word) <= 32 else xxhash.xxh3_64_intdigest(word)


def cuts(words: list[str]) -> list[int]:
    """Positions of the words that end a unit of a long stretch, ascending."""
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(WINDOW - 1, len(h)) - np.argmin(windows[:, ::-1], axis=1)).tolist()


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences with words; they partition the text
    but for blank pieces."""
    out, at = [], 0
    for e in (*(m.end() for m in END.finditer(text)), len(text)):
        words = text[at:e].split()
        if len(words) > LONG_SENTENCE:
            stops = [m.end() for m in WORD.finditer(text, at, e)]
            begin, k = at, 0
            for c in cuts(words):
                out.append((begin, stops[c], words[k:c + 1]))
                begin, k = stops[c], c + 1
            if k < len(words):
                out.append((begin, e, words[k:]))
        elif words:
            out.append((at, e, words))
        at = e
    return out


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def runs(text: str | None):
    """Arrays (h1, h2, first, last) of the text's runs of sentences, or None."""
    units = sentences(text or "")
    n = len(units)
    if n < MIN_SENTENCES:
        return None
    count = np.zeros(n + 1, np.int64)
    np.cumsum([len(u[2]) for u in units], out=count[1:])
    if count[n] < MIN_WORDS:
        return None
    i = np.arange(n)
    forward = np.maximum(np.searchsorted(count, count[i] + MIN_WORDS) - 1, i + MIN_SENTENCES - 1)
    back = np.minimum(np.searchsorted(count, count[i + 1] - MIN_WORDS, "right") - 1, i - MIN_SENTENCES + 1)
    first = np.concatenate([i[forward < n], back[back >= 0]])
    last = np.concatenate([forward[forward < n], i[back >= 0]])
    both = np.unique(first * n + last)
    first, last = both // n, both % n
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(u[2])) for u in units), "<u8").reshape(n, 2)
    out = []
    with np.errstate(over="ignore"):
        up, down = _powers(_BASE, n), _powers(_INVERSE, n)
        for half in (0, 1):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(digests[:, half] * up, out=total[1:])
            out.append(((total[last + 1] - total[first]) * down[first]).view(np.int64))
    return out[0], out[1], first.astype(np.int32), last.astype(np.int32)


def cut(text: str | None, spans) -> tuple[str | None, int]:
    """The text without the sentences of ``spans`` (first << 32 | last), and their number."""
    if not spans:
        return text, 0
    units = sentences(text)
    drop = np.zeros(len(units) + 1, np.int64)
    for s in spans:
        drop[s >> 32] += 1
        drop[(s & 0xFFFFFFFF) + 1] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    out, at = [], 0
    for (s, e, _), g in zip(units, gone):
        if g:
            out.append(text[at:s])
            if text[s:e].endswith("\n") and not "".join(out[-1:]).endswith("\n"):
                out.append("\n")
            at = e
    out.append(text[at:])
    return "".join(out).strip(), int(gone.sum())


def remove_repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text_col`` freed of sentences that a non-first repeated run
    covers, plus n_removed (a column of this name is replaced).

    Null texts stay null, texts without long enough runs stay as they are.  Rows
    equal in id and text are one document (all get the same result); a null id
    comes before all others.  Runs may repeat within a text; then the first of
    them stays.  An empty table gives an empty result.

    Texts are parsed once into a table of runs (40 bytes each).  Only run hashes and
    counts, merged before the shuffle, are grouped over all runs; the places of runs
    that repeat are then joined out, and the first of each is found among those.
    The plan is the same at every size; hot runs are split by the adaptive join.
    """
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__t")]
    src = docs.select(*key, F.col(text_col).alias("__text"))
    places = written(explode_values(src, "__text", ["__id", "__t"], "h1 long, h2 long, first int, last int", lambda: runs))
    repeated = places.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    held = written(places.join(written(repeated), ["h1", "h2"]))
    discard(places)
    place = F.struct("__id", "__t", "first")
    span = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    keep = held.groupBy("h1", "h2").agg(F.min(place).alias("keep"))
    gone = held.join(keep, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keep"))) \
        .groupBy("__id", "__t").agg(F.collect_set(span).alias("__gone")).withColumnsRenamed({"__id": "__i", "__t": "__u"})
    rest = [c for c in docs.columns if c not in (text_col, "n_removed")]
    left = docs.select(F.struct(*rest).alias("__row"), *key, F.col(text_col).alias("__text"))
    both = left.join(gone, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")), "left")
    got = map_texts(both.select("__row", F.struct("__text", "__gone").alias("__v")), "__v", ["__row"],
                    f"{text_col} string, n_removed long",
                    lambda: lambda rows: [cut(r["__text"], r["__gone"]) for r in rows])
    return got.select("__row.*", text_col, "n_removed")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
