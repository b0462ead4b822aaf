"""Vector code compression: product quantisation with adaptive distance bounds.

Vectors become integers, are cut into equal parts, and every part position learns
a codebook by Lloyd rounds.  As in Drake and Hamerly's k-means every part keeps,
between rounds, an upper bound on the distance to its entry, the ``b`` closest
other entries with ordered lower bounds, and one outer bound for all the rest.
Bounds follow the entries' moves; only parts whose bounds overlap are looked at
again, with exact integer distances, and ``b`` shrinks to what a round needed.

A round is one map over the table of states (vectors ride along), written to the
work folder; its tasks also leave their partial sums there as rows of their own.
Codebooks (entries x dimension integers) are all that is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm.catalog import query
from exposcope.llm.common import discard, packed, table, unpacked, written
from exposcope.operators.joins import attach
from exposcope.session import ship_package

#: Parts of a vector, entries of a codebook, rounds, and the scale of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that a task works on at one time.
BLOCK = 4096


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.einsum("nd,nd->n", d, d)
    return out


def roots(d2: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers at or below, and at or above, the distances in steps of 2**shift."""
    low = np.sqrt(d2.astype(np.float64)).astype(np.int64)
    low -= low * low > d2
    high = low + (low * low < d2)
    return low >> shift, -((-high) >> shift)


@dataclass
class Bounds:
    """State of one part position for a block of rows.  ``low[:, i]`` is a lower bound
    for ``near[:, i]`` and everything after it; the last column is the outer bound."""
    mine: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray

    @staticmethod
    def blank(n: int, b: int) -> "Bounds":
        return Bounds(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, b), np.int64), np.zeros((n, b + 1), np.int64))

    def order(self) -> None:
        self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]

    def settle(self, x: np.ndarray, c: np.ndarray, rows: np.ndarray, shift: int, top: int) -> None:
        """Look at all entries for ``rows``."""
        if not len(rows):
            return
        b, d2 = self.near.shape[1], squares(x[rows], c)
        by = np.argsort(d2, axis=1, kind="stable")  # equal distances: the lower index
        d2 = np.take_along_axis(d2, by, axis=1)
        low, high = roots(d2, shift)
        self.mine[rows], self.upper[rows], self.near[rows] = by[:, 0], high[:, 0], by[:, 1:b + 1]
        self.low[rows] = np.concatenate([low, np.full((len(rows), 1), top)], axis=1)[:, 1:b + 2]

    def move(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray, shift: int, top: int, depths: np.ndarray) -> None:
        """Follow the entries' moves and mend what the bounds leave open."""
        b = self.near.shape[1]
        self.upper += drift[self.mine]
        self.low[:, :b] -= drift[self.near]
        self.low[:, b] -= drift.max()
        np.maximum(self.low, 0, out=self.low)
        self.order()
        open_ = np.flatnonzero(self.upper >= self.low[:, 0])
        if len(open_):  # tighten the upper bound first
            d = x[open_] - c[self.mine[open_]]
            self.upper[open_] = roots(np.einsum("nd,nd->n", d, d), shift)[1]
            open_ = open_[self.upper[open_] >= self.low[open_, 0]]
        depth = (self.upper[open_, None] >= self.low[open_]).sum(axis=1)  # of ordered bounds: a prefix
        depths += np.bincount(depth, minlength=len(depths))
        for z in range(1, b + 1):
            rows = open_[depth == z]
            if not len(rows):
                continue
            some = np.concatenate([self.mine[rows, None], self.near[rows, :z]], axis=1)
            some.sort(axis=1)  # so that a stable sort by distance takes the lower index
            d = x[rows, None, :] - c[some]
            d2 = np.einsum("nzd,nzd->nz", d, d)
            by = np.argsort(d2, axis=1, kind="stable")
            some, d2 = np.take_along_axis(some, by, axis=1), np.take_along_axis(d2, by, axis=1)
            low, high = roots(d2, shift)
            self.mine[rows], self.upper[rows] = some[:, 0], high[:, 0]
            self.near[rows, :z], self.low[rows, :z] = some[:, 1:], low[:, 1:]
        self.settle(x, c, open_[depth > b], shift, top)
        self.order()

    def narrowed(self, b: int) -> "Bounds":
        return Bounds(self.mine, self.upper, self.near[:, :b], self.low[:, :b + 1])


@dataclass
class Layout:
    """How a state is stored: integers as small as the data allow, bounds as 16 bits
    in steps of 2**shift (lower ones rounded down, upper ones up)."""
    dim: int
    parts: int
    most: int  # the largest absolute component

    def __post_init__(self):
        if 4 * (self.most + 1) ** 2 * max(self.dim, 1) >= 1 << 63:
            raise ValueError(f"components up to {self.most} have squared distances beyond 64 bits")
        self.kind = next(t for t in ("<i2", "<i4", "<i8") if self.most < 1 << (8 * int(t[2]) - 1))
        width = max(self.dim // self.parts, 1)
        self.shift = max(0, int(2 * (self.most + 1) * width ** 0.5 + 1).bit_length() - 14)

    def cut(self, x: np.ndarray, p: int) -> np.ndarray:
        w = self.dim // self.parts
        return x[:, p * w:(p + 1) * w]

    def store(self, states: list[Bounds]) -> pa.Array:
        small, wide = [], []
        for s in states:
            small += [s.mine[:, None], s.near]
            wide += [s.upper[:, None], s.low]
        return packed(np.concatenate([np.concatenate(small, axis=1).astype("u1"),
                                      np.minimum(np.concatenate(wide, axis=1), 65535).astype("<u2").view("u1")], axis=1))

    def load(self, column: pa.Array, b: int) -> list[Bounds]:
        raw = unpacked(column, np.uint8)
        n, at = len(raw), self.parts * (b + 1)
        small = raw[:, :at].astype(np.int64).reshape(n, self.parts, b + 1)
        wide = np.ascontiguousarray(raw[:, at:]).view("<u2").astype(np.int64).reshape(n, self.parts, b + 2)
        return [Bounds(small[:, p, 0].copy(), wide[:, p, 0].copy(), small[:, p, 1:].copy(), wide[:, p, 1:].copy())
                for p in range(self.parts)]


@dataclass
class Codebooks:
    """Entries (parts, entries, dimensions of a part), the coded table and the widths
    ``b`` that the rounds used."""
    entries: np.ndarray
    codes: DataFrame
    widths: list[int]

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, vector_col: str, parts: int, scale: int) -> tuple[DataFrame, int, int]:
    """Rows that can be coded with ``__x`` (floor of scale * component), the common
    length and the largest absolute component."""
    x = F.col(vector_col)
    ok = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.coalesce(ok, F.lit(False)))
    most = F.max(F.greatest(F.abs(F.array_min(x).cast("double")), F.abs(F.array_max(x).cast("double"))))
    # one row per length, of which a table has one; the cap on rows read here is far above that
    sizes = kept.groupBy(F.size(x).alias("dim")).agg(F.count("*").alias("n"), most.alias("most"))
    row = sizes.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if row is None:
        return kept.select("*", F.lit(None).cast("array<bigint>").alias("__x")), 0, 0
    top = row["most"] * scale
    if top >= 2.0 ** 62:
        raise ValueError(f"components up to {row['most']} don't fit 64-bit integers")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return kept.where(F.size(x) == row["dim"]).select("*", whole.alias("__x")), row["dim"], int(top) + 1


def compress(vectors: DataFrame, vector_col: str = "embedding", key: str = "vec_id", keep=("label",),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Learn codebooks and code every vector: ``codes`` has ``key``, ``keep``, ``code``
    (a byte per part, in hex) and ``error`` (squared distances summed over parts).

    Rows whose vector is null, empty, holds a null, NaN or infinite component, has a
    length that ``parts`` doesn't divide, or another length than most rows (ties:
    the longer) have no code and are left out.  A codebook starts from the rows of
    the ``entries`` smallest keys (null keys are coded, but start none; rows with
    one key go by their components); fewer rows give fewer entries, and a table
    whose rows all lack keys starts from all-zero entries.  Repeated rows are coded
    each; an empty table gives an empty result.  Other columns aren't carried.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    keep = [c for c in keep if c != key]
    names = [key, *keep]
    base = vectors.select(*[F.col(c) for c in names],
                          F.col(vector_col).alias("__v"))
    kept, dim, most = integers(base, "__v", parts, scale)
    typed = kept.select(*names).schema.fields
    if not dim:
        none = kept.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codebooks(np.zeros((parts, 0, 0), np.int64), none, [])
    form = Layout(dim, parts, most)
    seeds = kept.where(F.col(key).isNotNull()).orderBy(key, "__x").limit(entries).select("__x").collect()
    first = np.array([r["__x"] for r in seeds], np.int64) if seeds else np.zeros((1, dim), np.int64)
    books = [np.stack([form.cut(first, p) for p in range(parts)])]
    k = len(first)
    b = min(max(k // 4, 1), k - 1)
    widths, top = [b], 32767
    state_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed) \
        + ", __x binary, __s binary, __sums array<bigint>"
    code_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed) + ", code string, error bigint"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                yield whole.slice(at, BLOCK)

    def vector_of(batch: pa.RecordBatch, initial: bool) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index("__x"))
        if initial:
            return np.asarray(column.flatten(), np.int64).reshape(batch.num_rows, dim)
        return unpacked(column, form.kind).astype(np.int64)

    def rows_of(batch, x, states):
        return pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(c)) for c in names], packed(x.astype(form.kind)), form.store(states),
             pa.nulls(batch.num_rows, pa.list_(pa.int64()))], names=[*names, "__x", "__s", "__sums"])

    def assign(new: np.ndarray, drift: np.ndarray | None, b_old: int, b: int):
        """One pass: states for the entries ``new`` and, per task, sums, counts and depths."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = dim // parts
            sums, counts = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
            depths, schema = np.zeros(k + 2, np.int64), None
            for batch in blocks(batches):
                x = vector_of(batch, drift is None)
                states = []
                old = None if drift is None else form.load(batch.column(batch.schema.get_field_index("__s")), b_old)
                for p in range(parts):
                    part = form.cut(x, p)
                    if old is None:
                        s = Bounds.blank(len(x), b)
                        s.settle(part, new[p], np.arange(len(x)), form.shift, top)
                        s.order()
                    else:
                        s = old[p].narrowed(b)
                        s.move(part, new[p], drift[p], form.shift, top, depths)
                    for j in range(w):
                        # float64 sums of a block would round; integers don't
                        np.add.at(sums[p, :, j], s.mine, part[:, j])
                    counts[p] += np.bincount(s.mine, minlength=k)
                    states.append(s)
                out = rows_of(batch, x, states)
                schema = out.schema
                yield out
            if schema is not None:
                flat = np.concatenate([sums.ravel(), counts.ravel(), depths])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, f.type) for f in schema][:-1], pa.array([flat.tolist()], pa.list_(pa.int64()))], schema=schema)
        return run

    def finish(new: np.ndarray, drift: np.ndarray, b_old: int, b: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                x = vector_of(batch, False)
                codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, s in enumerate(form.load(batch.column(batch.schema.get_field_index("__s")), b_old)):
                    s, part = s.narrowed(b), form.cut(x, p)
                    s.move(part, new[p], drift[p], form.shift, top, np.zeros(k + 2, np.int64))
                    d = part - new[p][s.mine]
                    codes[:, p], error = s.mine, error + np.einsum("nd,nd->n", d, d)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in names],
                     pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=[*names, "code", "error"])
        return run

    def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
        d = new - old
        return roots(np.einsum("pkd,pkd->pk", d, d), form.shift)[1]

    state = written(kept.select(*names, "__x").mapInArrow(assign(books[0], None, b, b), state_schema))
    b_old = b
    for r in range(1, rounds + 1):
        new, depths = _update(state, books[-1])
        drift = drifts(books[-1], new)
        books.append(new)
        used = np.flatnonzero(depths[1:b + 1])
        if r > 1:  # the first pass looks at everything and says nothing about b
            b = min(b, max(int(used[-1]) + 1 if len(used) else 1, k // 8, 1))
        source = state.where(F.col("__sums").isNull()).select(*names, "__x", "__s")
        if r < rounds:
            after = written(source.mapInArrow(assign(new, drift, b_old, b), state_schema))
        else:
            after = written(source.mapInArrow(finish(new, drift, b_old, b), code_schema))
        discard(state)
        state, b_old = after, b
        widths.append(b)
    return Codebooks(books[-1], state, widths)


def _update(state: DataFrame, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next entries from the tasks' partial sums (floor of the mean; unused ones
    stay) and the counts of depths."""
    rows = state.where(F.col("__sums").isNotNull()).select(F.posexplode("__sums").alias("at", "v")) \
        .groupBy("at").agg(F.sum("v").alias("v")).collect()  # entries x (dimension + 1) numbers
    flat = np.zeros(max((r["at"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        flat[r["at"]] = r["v"]
    sums = flat[:old.size].reshape(old.shape)
    n = flat[old.size:old.size + old.shape[0] * old.shape[1]].reshape(old.shape[:2])
    return np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], old), flat[old.size + n.size:]


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together."""
    sums = codes.groupBy(label).agg(F.sum("error").alias("label_error"))
    return attach(codes, sums, [label])


def _sql() -> str:
    """The same in SQL: unrolled rounds over (vec_id, part, position, component)."""
    with_ = ["k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings "
             "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
             f"c AS MATERIALIZED (SELECT rid, (i - 1) // (len(embedding) // {PARTS}) AS p, (i - 1) % (len(embedding) // {PARTS}) AS j, "
             f"CAST(floor({SCALE}e0 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT rid, embedding, "
             "unnest(range(1, len(embedding) + 1)) AS i FROM k))",
             "x AS MATERIALIZED (SELECT rid, p, list(v ORDER BY j) AS v FROM c GROUP BY 1, 2)",
             f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= {ENTRIES})"]
    pick = ("SELECT rid, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.rid, x.p, b.e, "
            "CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d "
            "FROM x JOIN b{r} b ON x.p = b.p) GROUP BY 1, 2")
    for r in range(ROUNDS):
        with_.append(f"a{r} AS MATERIALIZED ({pick.format(r=r)})")
        with_.append(
            f"m{r} AS (SELECT p, e, list(v ORDER BY j) AS v FROM (SELECT c.p, a.e, c.j, CAST((sum(c.v) - ((sum(c.v) % count(*)) "
            f"+ count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM c JOIN a{r} a ON c.rid = a.rid AND c.p = a.p "
            "GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        with_.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m "
                     "ON b.p = m.p AND b.e = m.e)")
    with_.append(f"f AS ({pick.format(r=ROUNDS)})")
    with_.append("o AS (SELECT k.vec_id, k.label, string_agg(format('{:02x}', f.e), '' ORDER BY f.p) AS code, "
                 "CAST(sum(f.d) AS BIGINT) AS error FROM f JOIN k USING (rid) GROUP BY k.rid, 1, 2)")
    return ("WITH " + ",\n".join(with_) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) "
            f"AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) "
            "AS codebooks_sha256 FROM o")


@query("op11_vector_codes", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(books.codes).select("vec_id", "code", "error", "label_error",
                                            F.lit(books.digest).alias("codebooks_sha256"))
