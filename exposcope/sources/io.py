"""Scans and sinks (A1-A4).

Columnar Parquet between stages; CSV only at the edges.  Reads always carry
an explicit schema so that no inference pass runs over the data; CSV files tell
the order of their columns in their own headers.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposcope.functions.columns import bind
from exposcope.schema import EXPOSURE_SCHEMA
from exposcope.session import cut_lineage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Different headers among the files of one read; more is an error (each adds a parser to the plan).
MAX_LAYOUTS = 64


def read_events(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv",
                schema: T.StructType = EXPOSURE_SCHEMA,
                none_as_null: bool = False, bad: str | None = None) -> DataFrame:
    """A1: scan an event table (CSV with header, or Parquet).

    Every CSV file is read by its own header, its columns mapped to ``schema`` by name,
    so files of several layouts (the 14-column seed layout too) may lie in one folder;
    missing columns come back as null, other columns follow as strings.  Headers are
    found in executors: one job for all files, whatever their number.  Rows are lines.
    A line that repeats its file's header, as in concatenated files, is a header; blank
    lines are none.  A header that names no schema column is an error.

    A row that does not fit its header (a value that does not parse, too few or too many
    fields) is an error, or with ``bad`` its line goes to that column, which is null in
    good rows.  ``"None"`` stays a category value unless ``none_as_null``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        return conform(spark.read.parquet(*paths), schema)
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"),
                                          F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where(F.length(F.trim("value")) > 0)
    # a file's first line: the least position among the lines of its first split
    headers = cut_lineage(lines.where("start = 0").select("file", "value", F.monotonically_increasing_id().alias("at"))
                          .groupBy("file").agg(F.min_by("value", "at").alias("header")))
    texts = [r.header for r in headers.select("header").distinct().orderBy("header").limit(MAX_LAYOUTS + 1).collect()]
    if len(texts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers")
    if len(texts) > 1:
        size = headers.agg(F.sum(F.octet_length("file") + F.octet_length("header"))).first()[0]
        told = F.broadcast(headers) if size <= MAX_HEADERS_BYTES else headers
        lines = lines.join(told, "file")
    else:
        lines = lines.withColumn("header", F.lit(texts[0] if texts else None).cast("string"))
    layouts = [_layout(t, schema) for t in texts]
    extra = sorted({f.name for own in layouts for f in own} - set(schema.names))
    full = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in extra]])
    if bad is not None:
        if bad in full.names:
            raise ValueError(f"a column {bad} is there already")
        full = full.add(bad, T.StringType())
    parsed = F.lit(None).cast(full)
    for text, own in zip(texts, layouts):
        parsed = F.when(F.col("header") == text, bind(_parsed(own, none_as_null, bad), _widened(own, full, none_as_null, bad))).otherwise(parsed)
    return lines.where(F.col("value") != F.col("header")).select(parsed.alias("r")).select("r.*")


#: Files and headers that are handed to every task at most; beyond, lines are joined by a shuffle.
MAX_HEADERS_BYTES = 16 << 20


def _layout(header: str, schema: T.StructType) -> T.StructType:
    """The row type that a header line tells: schema types by name, else strings."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]))]
    by_name = {f.name: f for f in schema.fields}
    if not by_name.keys() & set(names):
        raise ValueError(f"no column of the schema in the header {names}")
    if len(set(names)) < len(names):
        raise ValueError(f"a name stands twice in the header {names}")
    return T.StructType([T.StructField(n, by_name[n].dataType if n in by_name else T.StringType()) for n in names])


def _parsed(own: T.StructType, none_as_null: bool, bad: str | None) -> Column:
    """A line as a struct of its layout (and ``bad``)."""
    options = {"nullValue": "None" if none_as_null else "", "emptyValue": "", "mode": "FAILFAST"}
    if bad is not None:
        own = T.StructType(own.fields).add(bad, T.StringType())
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    return F.from_csv("value", F.lit(own.toDDL()), options)


def _widened(own: T.StructType, full: T.StructType, none_as_null: bool, bad: str | None):
    """A function from the struct of a layout to one of all columns; absent ones are null."""
    have = {*own.names, bad}

    def value(row: Column, f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        v = row.getField(f.name)
        return F.nullif(v, F.lit("")) if none_as_null and f.dataType == T.StringType() else v

    return lambda row: F.struct(*[value(row, f).alias(f.name) for f in full])


def conform(df: DataFrame, schema: T.StructType = EXPOSURE_SCHEMA) -> DataFrame:
    """Cast to ``schema``; add absent columns as typed nulls; keep extra columns."""
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def parse_ts(df: DataFrame, col: str = "timestamp", fmt: str | None = None,
             out: str | None = None) -> DataFrame:
    """A2: string -> timestamp without time zone (unparsable -> null)."""
    c = F.col(col)
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(out or col, parsed.cast("timestamp_ntz"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """A3: table sink; partition by date for time-pruned reads downstream."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
