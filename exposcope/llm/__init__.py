"""Training-data pipeline operators; nothing outside this subpackage imports it."""

from exposcope.llm.catalog import ORACLES, QUERIES
from exposcope.llm import (  # noqa: F401  (registration)
    boilerplate, bpe, codes, decontaminate, langid, mil, neardup, pii, ranking, repetition, secrets, spans, toxicity,
)

__all__ = ["ORACLES", "QUERIES"]
