"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of 5-word shingles and a MinHash signature; texts
   with equal sets are one node (their smallest doc_id).
2. Signatures are cut into bands; nodes that agree on a band share a bucket.
3. Candidates are compared a batch of signature values at a time.  With m of n
   values equal and a uniform prior, the similarity is Beta(m+1, n-m+1); the pair
   is dropped once P(similarity >= threshold) falls below the miss probability.
4. Survivors are verified exactly on their full sets.

Buckets are first tested against one anchor each, so a bucket of k nodes makes
k - 1 pairs.  Members that are still in another component than the rest of their
bucket meet other anchors, and those left after that their whole bucket,
blockwise in numpy where it is large.  Links join nodes to components.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import broadcast_if_small, explode_values, map_texts, table, written
from exposcope.llm.components import connected_components

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: BANDS bands of ROWS values: a pair at the threshold shares none with probability 2e-5.
ROWS, BANDS = 6, 56
VALUES = ROWS * BANDS
#: Values compared before each look at the posterior, and the chance to drop a true pair at a look.
BATCHES = (32, 64, 96, 128, 192, 256, VALUES)
MISS = 1e-6
#: Chunks into which the partners of one anchor are dealt.
CHUNKS = 256
#: Further anchors, in each bucket others, for members off the bucket's main component.
ANCHORS = 3
#: Larger buckets are then compared in blocks of this size.
BLOCK = 64
#: Bytes of one side of a group in that comparison, about (a longer text is a block of its own).
GROUP_BYTES = 1 << 20

_MULTIPLIERS = np.random.default_rng(20_240_101).integers(0, 1 << 31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=None)
def least_matches(n: int, threshold: float = PERCENT / 100, miss: float = MISS) -> int:
    """Smallest m with P(similarity >= threshold | m of n equal) >= miss.  The Beta
    tail is the binomial sum P(Binomial(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased; words
    part at ASCII white space); fewer words are one shingle, none give no shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = one[: len(one) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h += one[k: len(one) - SHINGLE + 1 + k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> bytes:
    """Set size (32 bits) and the low 16 bits of VALUES MinHash values (odd
    multiples, modulo 2^32, of the shingles' folded hashes)."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(folded), 256):
        np.minimum(low, (folded[k:k + 256, None] * _MULTIPLIERS).min(axis=0), out=low)
    return np.uint32(len(shingles)).tobytes() + low.astype(np.uint16).tobytes()


def band_keys(sig: bytes):
    v = np.frombuffer(sig, np.uint16)[2:].astype(np.uint64).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = ((v + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return (h.view(np.int64),)


def _unpack(sigs) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, VALUES + 2)
    return raw[:, :2].copy().view(np.uint32)[:, 0].astype(np.int64), raw[:, 2:]


def survivors(size_a, a, size_b, b) -> np.ndarray:
    """Indices of the pairs of signature rows that no posterior bound prunes."""
    alive = np.flatnonzero(100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b))
    got, at = np.zeros(len(alive), np.int64), 0
    for n in BATCHES:
        got += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        ok = got >= least_matches(n)
        alive, got, at = alive[ok], got[ok], n
    return alive


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _bayes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            keep = survivors(*_unpack(f["va"]), *_unpack(f["vb"]))
            yield f[["a", "b"]].iloc[keep]


def _exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [_similar(x, y) for x, y in zip(f["va"], f["vb"])]
        yield f.loc[keep, ["a", "b"]]


def compare(pairs: DataFrame, values: DataFrame, fn) -> DataFrame:
    """The pairs (a, b) that ``fn`` keeps, given both nodes' values (node, value).

    An anchor's partners are dealt into CHUNKS chunks, so an anchor with very many
    partners is no single join key, and its value travels once per chunk."""
    p = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(CHUNKS)).cast("int").alias("chunk"))
    anchors = p.select("a", "chunk").distinct()
    if broadcast_if_small(pairs, 24) is not pairs:
        p, anchors = F.broadcast(p), F.broadcast(anchors)
    one = values.join(anchors, values["node"] == F.col("a")) \
        .select("a", "chunk", F.col("value").alias("va"))
    two = values.join(p, values["node"] == p["b"]).select("a", "chunk", "b", F.col("value").alias("vb"))
    return one.hint("merge").join(two, ["a", "chunk"]).select("a", "b", "va", "vb").mapInPandas(fn, "a long, b long")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, main): members of the buckets that still hold several
    components; ``main`` is the bucket's largest one."""
    m = members.join(broadcast_if_small(labels, 32), "node", "left") \
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    m = written(m)
    per = m.groupBy("key", "component").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.count("*").alias("components"), F.sum("n").alias("members"),
                                 F.max_by("component", "n").alias("main")).where("components > 1")
    per = written(per)
    return m.join(broadcast_if_small(per, 48), "key")


def star_pairs(open_: DataFrame) -> DataFrame:
    """Pairs between the members off a bucket's main component and members of it.

    A node asks each main component that it shares buckets with once, through
    ANCHORS members, other ones for each node: every bucket offers a few of its own,
    of which the asking node takes ANCHORS, however many buckets they meet in."""
    main = open_.where("component = main").groupBy("key", "main").agg(F.array_distinct(F.array(*[
        F.min_by("node", F.xxhash64("node", "key", F.lit(k))) for k in range(ANCHORS)])).alias("anchors"))
    main = broadcast_if_small(written(main), 40 + 16 * ANCHORS)
    both = open_.where("component <> main").select("key", "node").join(main, "key") \
        .select("node", "main", F.explode("anchors").alias("anchor"))
    asks = both.groupBy("node", "main").agg(F.array_distinct(F.array(*[
        F.min_by("anchor", F.xxhash64("anchor", "node", F.lit(k))) for k in range(ANCHORS)])).alias("anchors"))
    asks = asks.select("node", F.explode("anchors").alias("anchor"))
    return asks.select(F.least("anchor", "node").alias("a"), F.greatest("anchor", "node").alias("b")).distinct()


def cross_pairs(open_: DataFrame) -> DataFrame:
    """Pairs between the components of small buckets; one side is off the main one."""
    s = open_.where(F.col("members") <= BLOCK)
    a = s.where("component <> main").select("key", F.col("node").alias("x"), F.col("component").alias("cx"), "main")
    b = s.select("key", F.col("node").alias("y"), F.col("component").alias("cy"))
    both = a.join(b, "key").where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _similar_to(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted ``sets`` (none empty) are linked with the sorted set ``x``."""
    sizes = np.array([len(t) for t in sets])
    every = np.concatenate(sets)
    at = np.searchsorted(x, every)
    both = np.add.reduceat((x[np.minimum(at, len(x) - 1)] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= PERCENT * (len(x) + sizes - both)


def _block_links(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """One link of each asking member to each component in a block, where there is any."""
    found = []
    if len(left) and len(right):
        sl, vl = _unpack(left["value"])
        sr, vr = _unpack(right["r_value"])
        node, of, asks = (right[c].to_numpy() for c in ("r_node", "r_component", "r_asks"))
        full = [np.frombuffer(v, np.uint64) for v in right["r_full"]]
        for i, (me, mine) in enumerate(zip(left["node"], left["component"])):
            # two askers meet in two blocks; the smaller one asks
            other = np.flatnonzero((of != mine) & (~asks | (node > me)))
            near = other[survivors(np.full(len(other), sl[i]), np.repeat(vl[i:i + 1], len(other), 0), sr[other], vr[other])]
            if len(near):
                near = near[_similar_to(np.frombuffer(left["full"].iat[i], np.uint64), [full[k] for k in near])]
                _, one = np.unique(of[near], return_index=True)
                found += [(me, node[k]) for k in near[one]]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def block_links(open_: DataFrame, values: DataFrame) -> DataFrame:
    """Links (a, b) in large buckets between members off the main component and members
    of other components there.

    Buckets that share members are one cluster.  In each cluster the members that are
    off a main component ask; they and all members are dealt into blocks of about
    GROUP_BYTES, and a group holds one block of either with signatures and full
    sets.  So a member is copied once per block of the other side, however many
    buckets and components it meets, pairs never become rows, and no group grows with
    the cluster."""
    s = written(open_.where(F.col("members") > BLOCK).select("key", "node", "component", (F.col("component") != F.col("main")).alias("asks")))
    heads = broadcast_if_small(written(s.groupBy("key").agg(F.min("node").alias("a"))), 32)
    clusters = connected_components(s.join(heads, "key").select("a", F.col("node").alias("b")).distinct()) \
        .withColumnRenamed("component", "cluster")
    nodes = s.groupBy("node").agg(F.first("component").alias("component"), F.max("asks").alias("asks"))  # a node has one component
    nodes = written(nodes.join(broadcast_if_small(clusters, 32), "node").join(values, "node")
                    .withColumn("bytes", F.octet_length("value") + F.octet_length("full")))
    blocks = lambda what: F.greatest(F.ceil(F.sum(what) / GROUP_BYTES), F.lit(1)).cast("int")
    size = nodes.groupBy("cluster").agg(blocks(F.when(F.col("asks"), F.col("bytes")).otherwise(0)).alias("rows"), blocks("bytes").alias("columns"))
    sized = nodes.join(broadcast_if_small(written(size), 24), "cluster")
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = sized.where("asks").select("cluster", part("rows").alias("i"), every("columns").alias("j"), "node", "component", "value", "full")
    right = sized.select("cluster", part("columns").alias("j"), every("rows").alias("i"), "node", "component", "asks", "value", "full")
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return left.groupBy("cluster", "i", "j").cogroup(right.groupBy("r_cluster", "r_i", "r_j")) \
        .applyInPandas(_block_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks
    the row that has it.  Null and empty texts have no shingles and link with
    nothing.  Rows with a null id form no links and are kept (component null).
    Rows that repeat an id count as one document.  Other columns are ignored; an
    empty table gives an empty result.  Hash collisions aside (64 bits within a
    pair, 128 between sets) links are exact; a linked pair goes unseen only if it
    shares no band (2e-5 at the threshold, less above) or a look prunes it (MISS).
    """
    def make():
        def run(texts):
            out = []
            for t in texts:
                s = shingle_set(t)
                out.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), signature(s)) if len(s) else (0, None, None))
            return out
        return run

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(map_texts(src, "text", ["doc_id"], "n_shingles long, digest string, value binary", make))
    usable = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    copies = usable.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("__last")) \
        .where("first < __last").select("digest", "first")
    copies = broadcast_if_small(written(copies), 64)
    nodes = usable.join(copies, "digest", "left") \
        .where("first IS NULL OR first = doc_id").select(F.col("doc_id").alias("node"), "value")

    buckets = explode_values(nodes, "value", ["node"], "key long", lambda: band_keys)
    shared = written(buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
                     .where("a < b"))
    pairs = shared.where("n = 2").select("a", "b")
    large = broadcast_if_small(shared.where("n > 2").select("key", F.col("a").alias("anchor")), 32)
    members = written(buckets.join(large, "key").select("key", "node", "anchor"))
    stars = members.where("anchor < node").select(F.col("anchor").alias("a"), F.col("node").alias("b"))
    pairs = written(pairs.unionByName(stars).distinct())

    met = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    met = broadcast_if_small(met, 24)
    sigs = written(nodes.join(met, "node", "left_semi"))
    links = verified_links(pairs, sigs, src)
    labels = written(connected_components(links))

    members = members.select("key", "node")
    rest = written(open_members(members, labels))
    full = full_sets(src, rest.select("node").distinct())
    if rest.limit(1).count():
        likely = written(compare(written(star_pairs(rest)), sigs, _bayes).distinct())
        links = written(links.unionByName(compare(likely, full, _exact)).distinct())
        labels = written(connected_components(links))
        rest = written(open_members(members, labels))
    if rest.limit(1).count():
        small = written(cross_pairs(rest).join(pairs, ["a", "b"], "left_anti"))
        likely = written(compare(small, sigs, _bayes).distinct())
        both = sigs.join(full.withColumnRenamed("value", "full"), "node")
        links = written(links.unionByName(compare(likely, full, _exact)).unionByName(block_links(rest, both)).distinct())
        labels = written(connected_components(links))

    of = sets.join(copies, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("digest").isNotNull(), F.coalesce("first", "doc_id")).alias("node"))
    labels = broadcast_if_small(labels, 32)
    done = of.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def verified_links(pairs: DataFrame, sigs: DataFrame, src: DataFrame) -> DataFrame:
    """The pairs that no posterior bound prunes and that are linked on their full sets."""
    likely = written(compare(pairs, sigs, _bayes).distinct())
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    return written(compare(likely, full_sets(src, nodes), _exact).distinct())


def full_sets(src: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, value): the full shingle sets of the listed nodes only."""
    ids = broadcast_if_small(written(nodes.withColumnRenamed("node", "doc_id")), 24)
    wanted = src.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    return written(map_texts(wanted, "text", ["node"], "value binary",
                             lambda: lambda texts: [(shingle_set(t).tobytes(),) for t in texts]))


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
