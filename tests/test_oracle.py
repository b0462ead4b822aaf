"""Differential tests: every registered query with an oracle equals DuckDB on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Queries that train models come last; they share what the session trained.
TRAINING = ["a4_model_roundtrip", "f7_predict_models", "g14_feature_importances", "g6_random_forest", "g7_boosted_trees",
            "g8_cv_boosted", "g8_cv_forest", "l1_model_stream"]
NAMES = sorted(E.oracle_sql(), key=lambda n: (n in TRAINING, n))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, info = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, info
