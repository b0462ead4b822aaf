"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from exposcope.functions.columns import (
    clamp, lookup, ordinal_code, risk_label, display_name,
    round_half_even, fixed,
)

__all__ = ["clamp", "lookup", "ordinal_code", "risk_label", "display_name",
           "round_half_even", "fixed"]
