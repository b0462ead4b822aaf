"""The cleaning chain of the published pipeline as one composable function:
impute (median / mode) -> fill times -> check -> dedupe -> encode -> flag outliers.

Order matters: statistics are fitted before dedupe, over the duplicates too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposcope.operators.clean import any_null, assert_complete, columns_with_nulls, dedupe, forward_fill, written_dedupe
from exposcope.operators.encode import encode_all
from exposcope.operators.outliers import flag_outliers
from exposcope.schema import OUTLIER_FEATURES


def impute(df: DataFrame, numeric: Sequence[str] | None = None,
           categorical: Sequence[str] | None = None,
           exclude: Sequence[str] = ("risk_score", "anomaly_score", "_o"),
           exact: bool = True) -> DataFrame:
    """Median for numeric gaps, mode for categorical gaps (plus one null-count
    pass when the columns are discovered)."""
    from exposcope.operators.clean import numeric_columns, string_columns
    if numeric is None or categorical is None:
        found = columns_with_nulls(df, numeric_columns(df, exclude) + string_columns(df, exclude))
        numeric = numeric if numeric is not None else [c for c in found
                                                       if c in numeric_columns(df, exclude)]
        categorical = categorical if categorical is not None else [
            c for c in found if c in string_columns(df, exclude)]
    from exposcope.operators.clean import fit_medians, fit_modes
    med = fit_medians(df, numeric, exact)
    modes = fit_modes(df, categorical)
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double"))
             for c in numeric}
    fills.update({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in categorical})
    return df.withColumns(fills) if fills else df


def clean_events(raw: DataFrame, numeric: Sequence[str] | None = None,
                 categorical: Sequence[str] | None = None, materialize: bool = True,
                 timestamp: str = "ts", order: str = "_o") -> DataFrame:
    """Imputed, time-filled, complete and deduplicated events.

    Gaps in ``timestamp`` take the last earlier time in ``order`` of the rows (if both
    columns are there).  With ``materialize`` the result is written once to the shared
    checkpoint folder: every later fit (fences, scaler, codes) and the final query then
    read it instead of re-running the imputation scan and the dedupe shuffle (the
    published pipeline likewise hands a written table to its next stage).  Nulls that are
    left in that table raise ``IncompleteDataError`` (looked for in the written table:
    counting them on the way took as long as the rest of the write).
    """
    filled = impute(raw, numeric, categorical)
    if timestamp in raw.columns and order in raw.columns and columns_with_nulls(raw, [timestamp]):
        filled = forward_fill(filled, timestamp, [order])
    if not materialize:
        return dedupe(filled)
    rows, out = written_dedupe(filled)
    if any_null(rows, rows.columns):
        assert_complete(rows)  # counts the nulls with all copies, and raises
    return out


def preprocess(raw: DataFrame, numeric: Sequence[str] | None = None,
               categorical: Sequence[str] | None = None, flag: bool = True,
               outlier_cols: Sequence[str] = OUTLIER_FEATURES, materialize: bool = True) -> DataFrame:
    """Cleaned + encoded events (+ ``is_outlier``): the model input table."""
    out = encode_all(clean_events(raw, numeric, categorical, materialize))
    return flag_outliers(out, outlier_cols) if flag else out
