"""Imputation, forward fill, completeness, duplicates, clamping.

Fitted statistics (medians, modes) are small values computed by distributed
aggregations (exact medians by bounded-memory order-statistic selection, modes
by grouped counts), in the manner of a Spark ML ``fit``; the transform then
inlines them as literals, so it is a map-only projection with no join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposcope.functions.columns import clamp as clamp_col
from exposcope.session import cut_lineage, ship_package

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _one_row(df: DataFrame, exprs: list[Column]) -> dict:
    row = df.agg(*exprs).first()
    return row.asDict() if row is not None else {}


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    if not cols:
        return []
    got = _one_row(df, [F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return [c for c in cols if got.get(c)]


def any_null(df: DataFrame, cols: Sequence[str]) -> bool:
    """Whether any of ``cols`` holds a null.  A plain filter: a scan of Parquet skips what its
    statistics show to be without nulls (times apart, for which Spark does not look there)."""
    apart = [c for c, t in df.dtypes if c in cols and t == "timestamp_ntz"]
    for some in ([c for c in cols if c not in apart], apart):
        if some and not df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in some])).isEmpty():
            return True
    return False


def fit_medians(df: DataFrame, cols: Sequence[str], exact: bool = True,
                accuracy: int = 1_000_000) -> dict[str, float | None]:
    """Median per column (nulls skipped), linear interpolation between order
    statistics.  ``exact`` selects the order statistics with bounded memory
    (see ``quantiles.exact_quantiles``); ``exact=False`` uses one
    ``percentile_approx`` pass."""
    if not cols:
        return {}
    if exact:
        from exposcope.operators.quantiles import exact_quantiles
        q = exact_quantiles(df, cols, [0.5])
        return {c: q[c][0] for c in cols}
    return _one_row(df, [F.percentile_approx(c, 0.5, accuracy).cast("double").alias(c)
                         for c in cols])


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """Fill numeric gaps with the column median; filled columns become double."""
    if cols is None:
        cols = columns_with_nulls(df, numeric_columns(df, exclude))
    med = fit_medians(df, cols, exact)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double"))
                           for c in cols})


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties -> smallest value.

    One grouped count over (column, value) pairs for all columns together
    (distinct values are spread over tasks by the shuffle, with map-side
    combine), then the top row per column: no buffer holds all distinct values
    and the driver receives one row per column.
    """
    cols = list(cols)
    if not cols:
        return {}
    types = dict(df.dtypes)
    numeric = set(numeric_columns(df))

    def key(c):  # numeric columns tie-break on the number, others on the text
        return F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")

    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"),
                               key(c).alias("d")) for i, c in enumerate(cols)])
    counts = (df.select(F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull())
              .groupBy("p.c", "p.v", "p.d").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("c").agg(
        F.min_by("v", F.struct(-F.col("n"), F.col("d"), F.col("v"))).alias("v"))
    got = {r["c"]: r["v"] for r in best.collect()}
    out = {}
    for i, c in enumerate(cols):
        v = got.get(i)
        dtype = types[c]
        out[c] = v if v is None or dtype == "string" else \
            df.sparkSession.createDataFrame([(v,)], "v string").select(
                F.col("v").cast(dtype)).first()[0]
    return out


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None,
                exclude: Sequence[str] = ()) -> DataFrame:
    """Fill categorical gaps with the column mode."""
    if cols is None:
        cols = columns_with_nulls(df, string_columns(df, exclude))
    modes = fit_modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in cols})


def forward_fill(df: DataFrame, col: str, order_by: Sequence[str],
                 partition_by: Sequence[str] = (), bucket: Column | None = None,
                 out: str | None = None) -> DataFrame:
    """C4: carry the last non-null value forward in ``order_by`` order, per key of
    ``partition_by`` (null keys are keys; without any all rows are one).  Callers may
    still name a ``bucket`` within keys; the scan doesn't need it.

    A segmented scan over range partitions: rows are range-partitioned and sorted
    by (key, order), so a key with very many rows spreads over tasks.  One map fills
    inside each partition, in the order of the rows, and marks the rows at the start
    of the partition's first key that saw no value yet; each partition reports its
    last key and that key's last value.  These reports (a row per partition) give
    the value carried into each partition, which the marked rows take.
    """
    spark = df.sparkSession
    ship_package(spark)
    out = out or col
    keys, names = [f"__k{i}" for i in range(len(partition_by))], list(df.columns)
    order = [f"__o{i}" for i in range(len(order_by))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(*names, F.col(col).alias("__v"), *[F.col(c).alias(k) for c, k in zip(partition_by, keys)],
                  *[F.col(c).alias(o) for c, o in zip(order_by, order)])
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    d = (d.repartitionByRange(parts, *by) if by else d.repartition(1)).sortWithinPartitions(*by) \
        .withColumn("__pid", F.spark_partition_id())
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True, f.metadata) for f in d.select(*names, "__v", *keys, "__pid").schema],
                           T.StructField("__open", T.BooleanType()), T.StructField("__report", T.BooleanType())])
    filled = cut_lineage(d.mapInArrow(_fill_partitions(len(names), len(keys)), schema))
    carry = _carried(filled.where(F.col("__report")).select("__pid", *keys, "__v", "__open"), keys)
    rows = filled.where(~F.col("__report"))
    if not carry:
        return rows.select(*[F.col("__v").alias(out) if c == out else F.col(c) for c in names],
                           *([] if out in names else [F.col("__v").alias(out)]))
    into = spark.createDataFrame(list(carry.items()), T.StructType([
        T.StructField("__into", T.IntegerType()), T.StructField("__carry", filled.schema["__v"].dataType)]))
    # a row per partition that a key with a value goes on in
    rows = rows.join(F.broadcast(into), F.col("__pid") == F.col("__into"), "left")
    value = F.when(F.col("__open"), F.col("__carry")).otherwise(F.col("__v"))
    return rows.select(*[value.alias(out) if c == out else F.col(c) for c in names],
                       *([] if out in names else [value.alias(out)]))


def _fill_partitions(width: int, n_keys: int):
    """The map of ``forward_fill``: rows in key order with ``__v`` filled as far as the
    partition knows, then one report (first and last key are told by its own rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # (last key and value so far as one-row arrays, whether still in the first key, any value seen)
        first_key, schema = None, None
        last_v, in_first, has = None, True, False
        for b in batches:
            if not b.num_rows:
                continue
            v, key_cols, pid = b.column(width), [b.column(width + 1 + k) for k in range(n_keys)], b.column(b.num_columns - 1)
            n = b.num_rows
            change = np.zeros(n, bool)  # rows whose key differs from the row before
            for k, c in enumerate(key_cols):
                before = pa.concat_arrays([(state[k] if state else c.slice(0, 1)), c.slice(0, n - 1)])
                differ = np.asarray(pc.fill_null(pc.not_equal(c, before), False)) if not pa.types.is_null(c.type) else np.zeros(n, bool)
                change |= differ | (np.asarray(c.is_null()) != np.asarray(before.is_null()))
            if first_key is None:
                first_key = [c.slice(0, 1) for c in key_cols]
            # position of the last value at or before each row, in an array that starts with the carried one
            source = pa.concat_arrays([last_v if last_v is not None else pa.nulls(1, v.type), v])
            at = np.arange(1, n + 1)
            seen = np.maximum.accumulate(np.where(np.asarray(v.is_valid()), at, 0))
            start = np.maximum.accumulate(np.where(change, at, 0))  # 0: the key that goes on from before
            at = np.where(seen >= np.maximum(start, 1), seen, 0)
            known = (at > 0) | ((start == 0) & has)
            got = source.take(pa.array(np.where(at > 0, at, 0), mask=~known))
            open_ = ~known & (start == 0) & in_first
            out = [*b.columns[:width], got, *key_cols, pid, pa.array(open_), pa.array(np.zeros(n, bool))]
            batch = pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:width + 1 + n_keys], "__pid", "__open", "__report"])
            schema = batch.schema
            yield batch
            state = [c.slice(n - 1, 1) for c in key_cols]
            last_v, has = got.slice(n - 1, 1), bool(known[-1])
            in_first = in_first and not change.any()
        if schema is not None:
            blank = [pa.nulls(2, schema.field(i).type) for i in range(width)]
            pids = pid.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.concat_arrays([pa.nulls(1, last_v.type), last_v]),
                 *[pa.concat_arrays([a, z]) for a, z in zip(first_key, state)], pa.concat_arrays([pids, pids]),
                 # the first report row tells the first key, the second the last key and its value; __open: one key only
                 pa.array([in_first, None]), pa.array([True, True])], schema=schema)
    return run


def _carried(reports: DataFrame, keys: Sequence[str]) -> dict:
    """Partition -> value that the key it starts with brings from earlier partitions.
    Two report rows per partition: its first key, and its last key with the last value."""
    first, last = {}, {}
    for r in reports.collect():  # two rows per partition
        key = tuple(r[k] for k in keys)
        if r["__open"] is not None:
            first[r["__pid"]] = (key, r["__open"])
        else:
            last[r["__pid"]] = (key, r["__v"])
    out, key, value = {}, None, None
    for pid in sorted(first):
        starts, alone = first[pid]
        if key is not None and starts == key[0] and value is not None:
            out[pid] = value
        ends, own = last[pid]
        if alone and own is None and key is not None and starts == key[0]:
            own = value  # a partition inside one key without any value hands on what it got
        key, value = (ends,), own
    return out


class IncompleteDataError(ValueError):
    pass


def assert_complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Raise when any of ``cols`` still holds a null; return ``df`` otherwise."""
    cols = list(cols or df.columns)
    left = {c: n for c, n in _one_row(
        df, [F.count_if(F.col(c).isNull()).alias(c) for c in cols]).items() if n}
    if left:
        raise IncompleteDataError(f"nulls remain: {left}")
    return df


def _together(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Equal rows in one partition, each row moved once.  Grouping then needs no second
    shuffle and no combining before it: rows are mostly distinct, and a map task's hash
    table of whole rows outgrows its memory (well-packed files give it millions)."""
    return df.repartition(*[F.col(c) for c in cols])


#: Places for digests of repeated rows (one bit each: 16 MB), 1,024 of them in a row of the table.
PLACE_BITS, ROW_BITS = 27, 10


def _digest(df: DataFrame) -> Column:
    """Equal for equal rows (0.0 and -0.0 are one, as when rows are grouped)."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def _places_of_repeats(digests: DataFrame) -> DataFrame:
    """(bucket, words): the places of all digests ``__h`` that come twice or more.  A table of
    bounded size, whatever the number of rows; other digests may share a place."""
    place = F.shiftrightunsigned("__h", 64 - PLACE_BITS)
    repeated = digests.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(place.alias("__p"))
    words = (1 << ROW_BITS) // 64
    bit = F.expr("shiftleft(1L, CAST(__p & 63 AS INT))")
    word = F.shiftright("__p", 6).bitwiseAND(F.lit(words - 1))
    return cut_lineage(repeated.groupBy(F.shiftright("__p", ROW_BITS).alias("__bucket")).agg(
        *[F.bit_or(F.when(word == i, bit)).alias(f"w{i}") for i in range(words)])
        .select("__bucket", F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(words)]).alias("__words")))


def _with_repeats(df: DataFrame, places: DataFrame, repeats: bool) -> DataFrame:
    """The rows of ``df`` (with ``__h``) that may have copies, or those that have none."""
    place = F.shiftrightunsigned("__h", 64 - PLACE_BITS)
    d = df.withColumn("__p", place).join(  # at most 2 ** (PLACE_BITS - ROW_BITS) rows
        F.broadcast(places), F.shiftright("__p", ROW_BITS) == F.col("__bucket"), "left")
    word = F.col("__words")[F.shiftright("__p", 6).bitwiseAND(F.lit((1 << ROW_BITS) // 64 - 1)).cast("int")]
    hit = F.coalesce(word.bitwiseAND(F.expr("shiftleft(1L, CAST(__p & 63 AS INT))")) != 0, F.lit(False))
    return d.where(hit if repeats else ~hit).drop("__h", "__p", "__bucket", "__words")


def count_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier full row (one-row result).  A digest of
    each row is grouped; whole rows are, and exactly, where a digest may have come before."""
    d = df.withColumn("__h", _digest(df))
    g = _with_repeats(d, _places_of_repeats(d.select("__h")), True).groupBy(*df.columns).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows"))


def dedupe(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep one of each full-row duplicate (nulls compare equal)."""
    return df.dropDuplicates(list(subset)) if subset else _together(df, df.columns).dropDuplicates()


def written_dedupe(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C7 for rows that are written anyway: (all rows, distinct rows).  All rows are written
    once with a digest; only rows that may have copies are shuffled, and compared in full."""
    rows = cut_lineage(df.withColumn("__h", _digest(df)))
    places = _places_of_repeats(rows.select("__h"))
    copies = cut_lineage(_with_repeats(rows, places, True).dropDuplicates())
    return rows.drop("__h"), _with_repeats(rows, places, False).unionByName(copies)


def clamp(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None,
          out: str | None = None) -> DataFrame:
    """Clip a column into [lo, hi]."""
    return df.withColumn(out or col, clamp_col(col, lo, hi))
