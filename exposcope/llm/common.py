"""Shared helpers of the training-data operators: table access, Arrow row maps,
checked broadcasts and the work folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from exposcope.session import cut_lineage, ship_package

#: A table below this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows that are Python objects at one time.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder (see ``cut_lineage``)."""
    return cut_lineage(df)


def broadcast_if_small(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring ``df``: the sum of ``row_bytes`` (a
    column or an int) over all rows must stay below ``limit``; otherwise the
    join keeps its shuffle.  ``df`` should be cheap to scan (written)."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def map_texts(df: DataFrame, text_col: str, keep: list[str], schema: str,
              make: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """Run a Python function over one text/binary column, Arrow batch by batch.

    ``make()`` runs once per task and returns ``f(values) -> list of tuples``,
    one tuple (matching ``schema``) per value, nulls included.  The columns in
    ``keep`` ride along unchanged; nothing else crosses to Python.
    """
    ship_package(df.sparkSession)
    added = StructType.fromDDL(schema)
    kept = df.select(*keep).schema
    types = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            rows = fn(b.column(b.num_columns - 1).to_pylist())
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(list(c), type=t) for c, t in zip(cols, types))],
                names=[*kept.names, *names])

    source = df.select(*keep, F.col(text_col).alias("__value"))
    return source.mapInArrow(run, StructType([*kept.fields, *added.fields]))


def explode_values(df: DataFrame, value_col: str, keep: list[str], schema: str,
                   make: Callable[[], Callable]) -> DataFrame:
    """Several rows per value: ``make()`` returns ``f(value) -> tuple of equally
    long numpy arrays`` (one per column of ``schema``) or None for no rows."""
    import numpy as np

    ship_package(df.sparkSession)
    added = StructType.fromDDL(schema)
    kept = df.select(*keep).schema
    types = [to_arrow_type(f.dataType) for f in added]
    names = [*kept.names, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            at, parts = [], []
            size = 0

            def flush():
                index = pa.array(np.repeat(np.array([k for k, _ in at]), [n for _, n in at]))
                cols = [np.concatenate(x) for x in zip(*parts)]
                return pa.RecordBatch.from_arrays(
                    [*(c.take(index) for c in b.columns[:-1]),
                     *(pa.array(c, type=t) for c, t in zip(cols, types))], names=names)

            for k, v in enumerate(b.column(b.num_columns - 1)):
                got = fn(v.as_py())
                if got is not None and len(got[0]):
                    at.append((k, len(got[0])))
                    parts.append(got)
                    size += len(got[0])
                if size > 100_000:
                    yield flush()
                    at, parts, size = [], [], 0
            if parts:
                yield flush()

    return df.select(*keep, F.col(value_col).alias("__value")).mapInArrow(
        run, StructType([*kept.fields, *added.fields]))


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``, once later tables replace it."""
    files = df.inputFiles()
    if files:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getName().startswith("t-"):  # a folder of cut_lineage, never an input
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def packed(values: "np.ndarray") -> pa.Array:
    """Rows of a 2-D array as a binary column."""
    import numpy as np

    values = np.ascontiguousarray(values)
    n, width = len(values), values.itemsize * values.shape[1]
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.Array, dtype) -> "np.ndarray":
    """The 2-D array behind a binary column of equally long values without nulls."""
    import numpy as np

    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    flat = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return flat.reshape(n, -1).view(dtype)
