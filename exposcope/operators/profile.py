"""Profiling reports (C1, C9, C10, H3, H13) — each one aggregate pass.

Wide one-row aggregates are turned long with ``stack`` so the report has one
row per column; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposcope.operators.clean import numeric_columns


def _stack(df_one_row: DataFrame, names: Sequence[str], fields: Sequence[str],
           key: str = "column") -> DataFrame:
    """Wide row with columns ``{name}__{field}`` -> one row per name."""
    n = len(names)
    parts = []
    for nm in names:
        parts.append(f"'{nm}'")
        parts += [f"`{nm}__{f}`" for f in fields]
    expr = f"stack({n}, {', '.join(parts)}) AS ({key}, {', '.join(fields)})"
    return df_one_row.selectExpr(expr)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None,
                 only_with_nulls: bool = True) -> DataFrame:
    """Null count and % of rows per column."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in cols])
    long = _stack(agg.select("*", *[F.col("__rows").alias(f"{c}__rows") for c in cols]),
                  cols, ["null_count", "rows"])
    long = long.withColumn("null_pct", F.col("null_count") * 100.0 / F.col("rows")).drop("rows")
    return long.filter(F.col("null_count") > 0) if only_with_nulls else long


def dataset_summary(df: DataFrame, ts_col: str | None = "ts") -> DataFrame:
    """Rows, columns and time range in one row."""
    exprs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
    if ts_col and ts_col in df.columns:
        exprs += [F.min(ts_col).alias("ts_min"), F.max(ts_col).alias("ts_max")]
    return df.agg(*exprs)


def column_types(df: DataFrame) -> DataFrame:
    """C9 (schema part): position, name and type of each column, from metadata only."""
    rows = [(i + 1, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2,
                     exact: bool = True) -> DataFrame:
    """H3: count, mean, std (sample), min, quartiles, max per numeric column.

    Quartiles are exact (linear interpolation) unlike ``DataFrame.summary``.
    """
    cols = list(cols or numeric_columns(df))
    if exact:
        from exposcope.operators.quantiles import exact_quantiles
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    exprs: list[Column] = []
    for c in cols:
        x = F.col(c).cast("double")
        if exact:
            qs = F.array(*[F.lit(v).cast("double") for v in q[c]])
        else:
            qs = F.percentile_approx(x, [0.25, 0.5, 0.75], 100000)
        exprs += [
            F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
            (F.first(qs) if exact else qs).alias(f"{c}__q"), F.max(x).alias(f"{c}__max"),
        ]
    wide = df.agg(*exprs)
    fields = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    sel = []
    for c in cols:
        sel += [F.col(f"{c}__count").alias(f"{c}__count"), F.col(f"{c}__mean"),
                F.col(f"{c}__std"), F.col(f"{c}__min"),
                F.col(f"{c}__q")[0].alias(f"{c}__q25"), F.col(f"{c}__q")[1].alias(f"{c}__q50"),
                F.col(f"{c}__q")[2].alias(f"{c}__q75"), F.col(f"{c}__max")]
    long = _stack(wide.select(*sel), cols, fields)
    return long.select("column", "count", *[F.round(f, digits).alias(f) for f in fields[1:]])


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First n rows in a stated order (top-n, no full sort)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def preprocess_report(raw: DataFrame, cleaned: DataFrame, flagged: DataFrame,
                      outlier_col: str = "is_outlier") -> DataFrame:
    """Cleaning funnel — nulls imputed, duplicates dropped, outlier rows, final size."""
    before = raw.agg(F.count(F.lit(1)).alias("rows"),
                     sum(F.count_if(F.col(c).isNull()) for c in raw.columns).cast("long").alias("nulls"))
    after = cleaned.agg(F.count(F.lit(1)).alias("rows"))
    end = flagged.agg(F.count(F.lit(1)).alias("rows"), F.sum(outlier_col).cast("long").alias("out"))
    width = F.lit(len(flagged.columns)).cast("long")

    def long(one_row, **steps):  # one aggregate per table, turned long
        each = [F.struct(F.lit(k).alias("step"), v.alias("value")) for k, v in steps.items()]
        return one_row.select(F.explode(F.array(*each)).alias("r")).select("r.*")

    return (long(before, nulls_imputed=F.col("nulls"), rows_raw=F.col("rows"))
            .unionByName(long(after, rows_deduplicated=F.col("rows")))
            .unionByName(long(end, outlier_rows=F.col("out"), rows_final=F.col("rows"), columns_final=width)))
