"""Quality rules by repetition coverage.

Words are hashed once; rolling hashes give every n-gram of several lengths in
numpy; the characters inside n-grams (and lines) that occurred earlier in the
text are measured against all word characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import map_texts, table

#: n-gram length -> largest allowed share of characters inside repeated n-grams.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed share of lines, and of characters, inside repeated lines.
DUP_LINES, DUP_LINE_CHARS = 0.30, 0.20
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\v\f\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
          "dup_line_chars long, n_repeat_words long, "
          + ", ".join(f"cover_{n} double" for n in COVERAGE))


def first_seen(keys: np.ndarray) -> np.ndarray:
    """For each position whether its key is new (no earlier equal key)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    return new


def inside(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions covered by any of the length-``n`` windows in ``marks``."""
    delta = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + n, -1)
    return np.cumsum(delta[:size]) > 0


def measure(text: str | None) -> tuple:
    """The columns of SCHEMA for one whole text (null: no words, no lines)."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    seen: set[str] = set()
    dup, dup_chars = 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += len(x) - sum(map(x.count, SEPARATORS))
        else:
            seen.add(x)
    repeat, cover = 0, {k: 0.0 for k in COVERAGE}
    if n >= 3:
        size = np.fromiter((len(w) for w in words), np.int64, n)
        if not text.isascii():  # code points: bytes that do not continue one
            size = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
        one = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        rolling, length = one, 1
        with np.errstate(over="ignore"):
            for k in (3, *COVERAGE):
                if n < k:
                    break
                while length < k:
                    rolling = rolling[:-1] * _BASE + one[length:]
                    rolling = (rolling ^ (rolling >> np.uint64(31))) if length == 1 else rolling
                    length += 1
                new = first_seen(rolling)
                if new.all():  # longer n-grams cannot repeat either
                    break
                if k == 3:
                    again = ~new
                    repeat = int(inside(np.isin(rolling, rolling[again]), 3, n).sum())
                else:
                    cover[k] = float(size[inside(~new, k, n)].sum() / chars)
    return (n, chars, symbols, len(lines), dup, dup_chars, repeat, *cover.values())


def repetition(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, the measures of SCHEMA, and ``repetitive``: whether any
    share passes its limit.

    Null and empty texts have zero words and no share; a null key stays null;
    repeated rows are measured each; an empty table gives an empty result; other
    columns are not carried, so their names cannot clash.  Word hashes only meet
    words of the same text, so they need not agree between workers.
    """
    got = map_texts(df, text_col, list(keep), SCHEMA,
                    lambda: lambda texts: [measure(t) for t in texts])
    over = (F.col("n_dup_lines") > DUP_LINES * F.col("n_lines")) \
        | (F.col("dup_line_chars") > DUP_LINE_CHARS * F.col("word_chars"))
    for n, most in COVERAGE.items():
        over = over | (F.col(f"cover_{n}") > most)
    return got.withColumn("repetitive", over)


@query("op6_quality_repetition")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return repetition(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("repetitive")).alias("kept"),
        *[f"cover_{n}" for n in COVERAGE])
