"""Named queries over the provided tables, each paired with a DuckDB oracle."""

from exposcope.plans.catalog import ORACLES, QUERIES, query
from exposcope.plans import (  # noqa: F401  (registration)
    eda_queries, explain_queries, io_queries, ml_queries, prep_queries, risk_queries,
    timeseries_queries,
)

__all__ = ["QUERIES", "ORACLES", "query"]
