"""Joining small per-group parameters to all rows, and exact running counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposcope.session import cut_lineage

#: A parameter table of at most this many rows is broadcast; a larger one is
#: joined on (keys, salt), each group's rows being dealt over SALT parts.
MAX_BROADCAST_ROWS = 100_000
SALT = 32


def same(a: DataFrame, b: DataFrame, by: Sequence[str], prefix: str = "__k_"):
    """Null-safe equality of ``by`` in ``a`` with the renamed keys of ``b``."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{prefix}{c}"]) for c in by], F.lit(True))


def attach(df: DataFrame, params: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``params`` (one row per group of ``by``, null
    keys included).  The parameter table is written and counted first."""
    by = list(by)
    p = cut_lineage(params).withColumnsRenamed({c: f"__k_{c}" for c in by})
    if p.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(p), same(df, p, by), how).drop(*[f"__k_{c}" for c in by])
    p = p.withColumn("__k___salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT)).cast("int"))
    on = [*by, "__salt"]
    return d.join(p, same(d, p, on), how).drop("__salt", *[f"__k_{c}" for c in on])


def running_count(counts: DataFrame, by: Sequence[str], value: str, n: str = "n",
                  out: str = "before", descending: bool = False) -> DataFrame:
    """``counts`` (distinct ``by`` + ``value`` with a count ``n``) plus ``out``: the
    sum of ``n`` over the smaller values of the same group.

    The table is range-partitioned on (by, value) and written once with its
    partition number; sums inside a partition are shifted by the group's sums
    over earlier partitions (partitions x groups rows), so no task holds a
    whole group and both branches read the same ranges.
    """
    by = list(by)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = cut_lineage(counts.repartitionByRange(parts, *by, order).withColumn("__pid", F.spark_partition_id()))
    sums = t.groupBy(*by, "__pid").agg(F.sum(n).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__pid", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*by, "__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return attach(t, sums, [*by, "__pid"]).withColumn(out, (F.col("__off") + F.col("__in")).cast("long")) \
        .drop("__pid", "__off", "__in")
