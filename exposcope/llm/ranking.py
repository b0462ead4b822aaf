"""Ranked lexical search with norm buckets (LEMP).

Every document is a vector of integer term impacts, an item of the query set a
set of terms; the score is the inner product.  Vectors are ordered by length.
The longest ones are scored first and give every item a threshold: the score of
its ``top``-th document so far.  Then, bucket by bucket of vectors of similar
length, Cauchy-Schwarz drops (item, bucket) pairs that can't reach the threshold,
the bucket's largest impact per coordinate tells which of the item's terms a
document must hold at least one of, the impacts on those terms plus a bound on
the rest filter the documents, and survivors are scored exactly in integers.
Bounds are doubles with slack and only ever drop what is strictly below the
threshold, so ties and results don't depend on the buckets.

Only coordinates of the query set's terms are kept.  The query set is worked on in
blocks of items whose terms fit VOCABULARY_BYTES, so what a task holds is bounded.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import discard, map_texts, table, written
from exposcope.session import ship_package

#: Documents per item.
TOP = 50
#: Rows of a bucket: neighbours in the order of lengths.
BUCKET = 2048
#: Shares of the longest vectors that are scored before the next ones (the last round takes the rest).
FIRST_SHARES = (1 / 64, 1 / 8)
#: Term bytes of a block of items; an item is never split.
VOCABULARY_BYTES = 8 << 20
#: Slack of the floating-point bounds.
SLACK = 1 + 1e-9

#: A-Z to lower case, other ASCII characters than 0-9 a-z to blanks (fixed by the task).
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Queries:
    """A block of items: their ids, and their terms as numbers of the block's vocabulary."""
    items: list
    vocabulary: dict[bytes, int]
    members: list[np.ndarray]


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms): the distinct terms of each item id; ids without terms are left out."""
    each = map_texts(items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")), "text", ["item"],
                     "term array<binary>", lambda: lambda texts: [(sorted(set(terms(t))),) for t in texts])
    return written(each.select("item", F.explode("term").alias("term")).distinct()
                   .groupBy("item").agg(F.array_sort(F.collect_list("term")).alias("terms"))
                   .withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16)))


def blocks(found: DataFrame, most: int = VOCABULARY_BYTES) -> Iterator[Queries]:
    """The query set in blocks of items, each within ``most`` bytes of terms where items allow."""
    total, count = found.agg(F.sum("bytes"), F.count("*")).first()
    n = min(max(1, -(-2 * (total or 0) // most)), max(count, 1))  # half full on average
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    for b in range(n if count else 0):
        rows = found.where(part == b).orderBy("item").collect()
        vocabulary: dict[bytes, int] = {}
        members = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        if rows:
            yield Queries([r["item"] for r in rows], vocabulary, members)


def term_counts(docs: DataFrame, queries: Queries, key: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tf): a document's terms in all, and its counts of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def make():
        get = shared.value.get

        def count(texts):
            out = []
            for t in texts:
                words = terms(t)
                found = Counter(map(get, words))
                found.pop(None, None)
                by = sorted(found)
                out.append((len(words), by, [found[k] for k in by]))
            return out
        return count

    return written(map_texts(docs.select(F.col(key).alias("doc"), F.col(text_col).cast("binary").alias("text")), "text", ["doc"],
                             "n bigint, terms array<int>, tf array<bigint>", make))


def weights(counts: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term of the block, documents with terms, and all their terms."""
    docs, total = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # <= vocabulary
        df[r["term"]] = r["count"]
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64), docs, total


def lists(batch: pa.RecordBatch, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, values) of a list column without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = np.asarray(column.offsets, np.int64)
    return ends - ends[0], np.asarray(column.flatten(), dtype)


def impact_vectors(counts: DataFrame, weight: np.ndarray, docs: int, total: int) -> DataFrame:
    """(doc, terms, impacts, length) ordered by length, longest first; documents
    without an impact are left out."""
    key = counts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, term = lists(b, "terms", np.int64)
            _, tf = lists(b, "tf", np.int64)
            m = 50 + (50 * np.asarray(b.column(b.schema.get_field_index("n")), np.int64) * docs) // max(total, 1)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(at))))
            length = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, at[:-1]))  # no row is empty
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc")), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(at.astype(np.int32), pa.array(impact)), pa.array(length), pa.array(np.arange(b.num_rows))],
                names=["doc", "terms", "impacts", "length", "place"])

    vectors = counts.where(F.size("terms") > 0).mapInArrow(run, f"doc {key}, terms array<int>, impacts array<bigint>, length double, place bigint")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by place too, as copies of a text have one length and would all be in one range
    return written(vectors.where("length > 0").repartitionByRange(parts, F.col("length").desc(), "place")
                   .sortWithinPartitions(F.col("length").desc()).drop("place"))


class Bucket:
    """Impact vectors of similar length, by row and by coordinate."""

    def __init__(self, at: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray, size: int):
        self.at, self.term, self.impact, self.length = at, term, impact, length
        row = np.repeat(np.arange(len(length)), np.diff(at))
        order = np.argsort(term, kind="stable")
        self.row, self.by_term = row[order], impact[order].astype(np.float64)
        self.start = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.by_term, self.start[held])

    def survivors(self, members: np.ndarray, least: float) -> np.ndarray:
        """Rows that may score ``least`` or more on the terms ``members``."""
        members = members[self.most[members] > 0]
        if not len(members) or self.length.max() * math.sqrt(len(members)) * SLACK < least:
            return np.zeros(0, np.int64)
        top = self.most[members]
        by = np.argsort(-top, kind="stable")
        members, top = members[by], top[by]
        rest = np.concatenate([np.cumsum(top[::-1])[::-1], [0.0]]) * SLACK  # largest sum of the terms from i on
        if rest[0] < least:
            return np.zeros(0, np.int64)
        # a document without any of the first ``f`` terms stays below ``least``
        f = int(np.searchsorted(-rest, -least, side="right")) if least > 0 else len(members)
        spans = [slice(self.start[t], self.start[t + 1]) for t in members[:f]]
        rows = np.concatenate([self.row[s] for s in spans])
        own = np.concatenate([self.by_term[s] for s in spans])
        sums = np.bincount(rows, own, len(self.length))
        found = np.unique(rows)
        if least > 0 and f < len(members):
            left = self.length[found] ** 2 * SLACK - np.bincount(rows, own ** 2, len(self.length))[found] / SLACK
            beyond = np.sqrt(np.maximum(left, 0) * (len(members) - f))  # Cauchy-Schwarz on the other coordinates
            found = found[(sums[found] + np.minimum(beyond, rest[f])) * SLACK >= least]
        return found

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``; ``wanted`` marks the item's coordinates."""
        n = self.at[rows + 1] - self.at[rows]
        first = np.cumsum(n) - n
        where = np.arange(n.sum()) - np.repeat(first - self.at[rows], n)
        return np.add.reduceat(np.where(wanted[self.term[where]], self.impact[where], 0), first) if len(rows) else np.zeros(0, np.int64)


def candidates(vectors: DataFrame, queries: Queries, least: np.ndarray, top: int) -> DataFrame:
    """(q, doc, score): per task and item the best ``top`` documents of ``vectors`` that
    score above 0 and not below ``least`` (per item)."""
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast((queries.members, len(queries.vocabulary), least))
    kind = vectors.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size, least = shared.value
        least = least.copy()
        wanted = np.zeros(size, bool)
        best: list[list] = [[] for _ in members]  # a heap per item: worst first
        kind_ = None
        serial = 0
        for whole in batches:
            kind_ = whole.schema.field("doc").type
            for b in (whole.slice(k, BUCKET) for k in range(0, whole.num_rows, BUCKET)):
                at, term = lists(b, "terms", np.int64)
                _, impact = lists(b, "impacts", np.int64)
                bucket = Bucket(at, term, impact, np.asarray(b.column(b.schema.get_field_index("length"))), size)
                docs = b.column(b.schema.get_field_index("doc"))
                for q, mine in enumerate(members):
                    rows = bucket.survivors(mine, float(least[q]))
                    if not len(rows):
                        continue
                    wanted[mine] = True
                    score = bucket.scores(rows, wanted)
                    wanted[mine] = False
                    ok = (score > 0) & (score >= least[q])
                    heap = best[q]
                    for r, s in zip(rows[ok].tolist(), score[ok].tolist()):
                        d = docs[r].as_py()
                        serial += 1
                        entry = (s, d is not None, _Descending(d), serial, d)  # null ids last among equal scores
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[q] = max(least[q], heap[0][0])
        out = [(q, e[4], e[0]) for q, heap in enumerate(best) for e in heap]
        if out:
            q, d, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, kind_), pa.array(s, pa.int64())],
                                             names=["q", "doc", "score"])

    ship_package(vectors.sparkSession)
    return vectors.mapInArrow(run, f"q int, doc {kind}, score bigint")


class _Descending:
    """Reverses the order of an id."""
    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return self.v is not None and other.v is not None and other.v < self.v

    def __eq__(self, other):
        return self.v == other.v

    __hash__ = None


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows per item with their rank."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text_col: str = "text",
           item_key: str = "item_id", item_text: str = "text", block_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """Per item the ``top`` documents of highest score above 0: item, rank, doc, score.

    Rows of one item id (null is one) are one item with the terms of all its texts;
    items without terms have no result.  Every row of ``docs`` is a document, so
    repeated rows rank each; a null text has no terms and no rank; null ids come
    last among equal scores.  Empty tables give an empty result; other columns
    aren't used, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    found = query_terms(items, item_key, item_text)
    item_type = items.schema[item_key].dataType.simpleString()
    doc_type = docs.schema[key].dataType.simpleString()
    out = None
    for queries in blocks(found, block_bytes):
        counts = term_counts(docs, queries, key, text_col)
        weight, n, total = weights(counts, len(queries.vocabulary))
        vectors = impact_vectors(counts, weight, n, total)
        discard(counts)
        cuts = vectors.agg(F.percentile_approx("length", [1 - s for s in FIRST_SHARES], 10_000)).first()[0] or []
        best = None
        least = np.zeros(len(queries.items), np.int64)
        for low, high in zip([*cuts, None], [None, *cuts]):
            part = vectors
            if low is not None:
                part = part.where(F.col("length") >= low)
            if high is not None:
                part = part.where(F.col("length") < high)
            more = candidates(part, queries, least, top)
            best = written(ranked(more if best is None else more.unionByName(best.select(more.columns)), top))
            for r in best.where(F.col("rank") == top).select("q", "score").collect():  # a row per item
                least[r["q"]] = r["score"]
        discard(vectors)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(queries.items)], f"q int, item {item_type}")
        part = best.join(F.broadcast(names), "q").select("item", "rank", "doc", "score")  # a block of items
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item {item_type}, rank int, doc {doc_type}, score bigint")


_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
h AS (SELECT rid, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
c AS (SELECT count(*) AS docs, sum(n) AS total FROM h),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
t AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), c),
i AS MATERIALIZED (SELECT t.rid, t.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS impact
  FROM t JOIN w USING (term) JOIN h USING (rid), c),
s AS (SELECT item_id, rid, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY 1, 2 HAVING sum(impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN h USING (rid)) WHERE rank <= {TOP}"""


@query("op12_ranked_search", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
