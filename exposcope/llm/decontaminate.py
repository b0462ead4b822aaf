"""Benchmark decontamination with a distributed positional inverted index.

Training tokens are posted as term -> (text, positions).  A test phrase is
looked up from its rarest terms: their posting lists, each shifted by the term's
offset in the phrase, are intersected, and what is left is compared with the
text word by word.  Everything is DataFrame operations; texts are keyed by their
digest, so copies of a text share postings and hits, whatever their ids.

Only lists that are ever intersected are stored: those of the rarest terms of
test phrases.  How rare a term is, is counted over all training tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import broadcast_if_small, table, written

#: Words of a window; shorter items are one window.
WINDOW = 13
#: Rarest terms of each window whose lists are intersected before the exact comparison.
LISTS = 3
#: A text is contaminated if at least 1 word in HIT_SHARE lies in a window.
HIT_SHARE = 20
#: What separates words, before letters are lower-cased (fixed by the task).
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(word: Column) -> Column:
    """A-Z to lower case, other letters as they are (lower() is the fast test)."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    """Words as written; a leading or trailing separator leaves an empty word there."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1)


def words_of(text: Column) -> Column:
    """The words of a text (none for null), A-Z lower-cased."""
    return F.transform(F.filter(raw_words(text), lambda w: w != ""), _fold)


def _count(raw: Column) -> Column:
    return (F.size(raw) - F.when(F.element_at(raw, 1) == "", 1).otherwise(0)
            - F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)).cast("long")


def keyed(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts with their digest ``key`` (null text: the empty text)."""
    return texts.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, pos, term) for every token whose term is listed.  A leading separator
    leaves an empty first word, which shifts all positions of its text alike."""
    tokens = texts.select("key", F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    return tokens.select("key", "pos", _fold(F.col("word")).alias("term")).where("term <> ''") \
        .join(terms, "term", "left_semi")


def list_lengths(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in all texts (summed before the shuffle)."""
    return occurrences(texts, terms).groupBy("term").agg(F.count("*").alias("n"))


def build_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (term, key, pos) of the listed terms; the copies of a
    text post once."""
    return written(occurrences(texts, terms).groupBy("term", "key").agg(F.collect_set("pos").alias("at"))
                   .select("term", "key", F.explode("at").alias("pos")))


def test_units(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(unit, item, words): each different test text of each item that has words."""
    return items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")) \
        .where(F.size("words") > 0).distinct() \
        .select(F.xxhash64(F.col("item"), F.concat_ws(" ", "words")).alias("unit"), "item", "words")


def windows_of(units: DataFrame, size: int = WINDOW) -> DataFrame:
    """(unit, at, terms): every run of ``size`` words; a text of fewer words is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return units.select("unit", "words", F.explode(starts).alias("at")) \
        .select("unit", "at", F.slice("words", F.col("at") + 1, size).alias("terms"))


def rarest_terms(windows: DataFrame, lengths: DataFrame, lists: int = LISTS) -> DataFrame:
    """(unit, at, rank, term, offset) of each window's rarest terms.  Windows with
    a term that no text holds are left out, as they cannot occur."""
    term = windows.select("unit", "at", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    found = term.join(lengths, "term")
    whole = found.groupBy("unit", "at", "size").agg(
        F.count("*").alias("held"), F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    return whole.where("held = size").select(
        "unit", "at", F.posexplode(F.slice("by", 1, lists)).alias("rank", "t")) \
        .select("unit", "at", "rank", F.col("t.term").alias("term"), F.col("t.offset").alias("offset"))


def intersect(rarest: DataFrame, index: DataFrame, lists: int = LISTS) -> DataFrame:
    """(unit, at, key, start): where the shifted lists of a window's rarest terms meet."""
    one = rarest.where("rank = 0").join(index, "term") \
        .select("unit", "at", "key", (F.col("pos") - F.col("offset")).alias("start"))
    got = one
    for r in range(1, lists):
        more = rarest.where(F.col("rank") == r).select("unit", "at", "term", "offset")
        want = got.join(more, ["unit", "at"], "left")
        # a window with fewer terms than lists has nothing left to intersect
        short = want.where(F.col("term").isNull()).select(got.columns)
        got = want.where(F.col("term").isNotNull()) \
            .withColumn("pos", F.col("start") + F.col("offset")) \
            .join(index, ["term", "key", "pos"], "left_semi").select(got.columns).unionByName(short)
    return got


def phrase_matches(texts: DataFrame, items: DataFrame, id_col: str = "item_id",
                   text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, hits): the texts with candidates; ``hits`` holds an entry
    (item, start, size) per window occurrence, ``start`` counting words from 0
    (from 1 where the text begins with a separator).

    The index is built from ``texts`` (columns key, text).  Windows of a test text
    that begin at one shift against a training text form one candidate, so a
    text's candidates are bounded by the passages it shares; each window is
    compared word by word.  Only (key, text) of the texts is shuffled, once, and
    the same way at any size.
    """
    units = written(test_units(items, id_col, text_col))
    windows = written(windows_of(units, size))
    vocab = windows.select(F.explode("terms").alias("term")).distinct()
    vocab = broadcast_if_small(written(vocab), F.octet_length("term") + 48)
    lengths = written(list_lengths(texts, vocab))
    rarest = written(rarest_terms(windows, lengths))
    needed = broadcast_if_small(written(rarest.select("term").distinct()), F.octet_length("term") + 48)
    index = build_index(texts, needed)
    small = broadcast_if_small(units, F.size("words") * 24 + 64)
    found = intersect(rarest, index).groupBy("key", "unit", (F.col("start") - F.col("at")).alias("shift")) \
        .agg(F.collect_set("at").alias("at")).join(small, "unit") \
        .groupBy("key").agg(F.collect_list(F.struct("item", "shift", "at", "words")).alias("__c"))
    found = written(found).hint("shuffle_merge")
    got = texts.join(found, "key").withColumn("__words", F.transform(raw_words(F.col("text")), _fold))

    def same(c, at):
        here = F.slice("__words", F.greatest(c["shift"] + at, F.lit(0)) + 1, F.least(F.size(c["words"]), F.lit(size)))
        return (c["shift"] + at >= 0) & (here == F.slice(c["words"], at + 1, size))

    hits = F.flatten(F.transform("__c", lambda c: F.transform(
        F.filter(c["at"], lambda at: same(c, at)),
        lambda at: F.struct(c["item"].alias("item"), (c["shift"] + at).alias("start"),
                            F.least(F.size(c["words"]), F.lit(size)).alias("size")))))
    return got.select("key", hits.alias("hits")).dropDuplicates(["key"])


def proximity_matches(texts: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      terms: int = LISTS, slop: int = 20) -> DataFrame:
    """(key, item, start, end): places where the ``terms`` rarest words of an item
    (of those that the texts hold; all of them if they are fewer) all occur within
    ``slop`` words, in any order; ``start`` and ``end`` are the first and last of
    these positions.  Words that no text holds are left out of an item.

    Lists are met from the rarest term on: an occurrence of it opens a scope, cut
    into blocks of ``slop`` words so that the other lists join on (key, block).
    """
    every = written(test_units(items, id_col, text_col).select("item", F.col("words").alias("terms")))
    vocab = broadcast_if_small(written(every.select(F.explode("terms").alias("term")).distinct()),
                               F.octet_length("term") + 48)
    lengths = written(list_lengths(texts, vocab))
    held = every.select("item", F.explode("terms").alias("term")).distinct().join(lengths, "term") \
        .groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, terms).alias("by"))
    rank = written(held.select("item", F.size("by").alias("held"), F.posexplode("by").alias("rank", "t"))
                   .select("item", "held", "rank", F.col("t.term").alias("term")))
    index = build_index(texts, broadcast_if_small(written(rank.select("term").distinct()), F.octet_length("term") + 48))
    got = rank.where("rank = 0").join(index, "term") \
        .select("item", "held", "key", F.col("pos").alias("anchor"), F.col("pos").alias("start"), F.col("pos").alias("end"))
    for r in range(1, terms):
        short = got.where(F.col("held") <= r)  # has no more terms to meet
        post = rank.where(F.col("rank") == r).join(index, "term").select("item", "key", "pos") \
            .withColumn("block", F.floor(F.col("pos") / slop))
        scope = got.where(F.col("held") > r).withColumn("block", F.explode(F.sequence(
            F.floor((F.col("anchor") - slop) / slop), F.floor((F.col("anchor") + slop) / slop))))
        both = scope.join(post, ["item", "key", "block"]) \
            .withColumn("lo", F.least("start", "pos")).withColumn("hi", F.greatest("end", "pos")) \
            .where(F.col("hi") - F.col("lo") < slop)
        got = both.select("item", "held", "key", "anchor", F.col("lo").alias("start"), F.col("hi").alias("end")).distinct() \
            .unionByName(short)
    return got.select("key", "item", "start", "end").distinct()


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, else all) plus n_words, n_hit, n_items,
    items_sha256, contaminated (columns of these names are replaced).

    A word is hit if it lies in an occurrence of any item's window; a text is
    contaminated if it has hits and 1 word in HIT_SHARE at least is hit.  Null and
    empty texts have no words and are never contaminated; items without words
    never match; null or repeated ids don't matter, as texts are keyed by digest;
    repeated rows get equal results; empty tables give empty or clean results.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    texts = keyed(docs, text_col)
    hits = phrase_matches(texts, items)
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"].cast("string"))))
    hits = written(hits.select("key", F.size(covered).cast("long").alias("n_hit"),
                               F.size(names).cast("long").alias("n_items"),
                               F.sha2(F.array_join(names, ","), 256).alias("items_sha256")))
    rest = [c for c in (docs.columns if keep is None else keep) if c not in added]
    src = docs.select(F.struct(*rest).alias("__row"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"),
                      _count(raw_words(F.col(text_col))).alias("n_words"))
    hits = broadcast_if_small(hits.where("n_hit > 0"), 160)
    got = src.join(hits, src["__key"] == hits["key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return got.select("__row.*", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')".format(u=_UPPER, l=_LOWER)

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark),
v AS (SELECT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(greatest(len(w) - {WINDOW - 1}, 1)),
  lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM v),
o AS (SELECT r, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes),
m AS (SELECT o.r, o.i, o.n, v.item FROM o JOIN d ON o.r = d.r JOIN v ON o.n = v.n
  AND array_to_string(d.w[o.i + 1 : o.i + o.n], ' ') = v.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


@query("op4_proximity")
def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_near: how many items have their rarest words close together in the text."""
    docs = table(spark, sf_dir, "documents")
    near = proximity_matches(keyed(docs), table(spark, sf_dir, "benchmark"))
    near = broadcast_if_small(written(near.groupBy("key").agg(F.count_distinct("item").alias("n_near"))), 64)
    src = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    return src.join(near, "key", "left").select("doc_id", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
