"""exposcope — exposure-risk analytics as Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame (or a small fitted
parameter object, in the style of Spark ML estimators).  Heavy work stays in
Catalyst / Tungsten; Python workers appear only in the isolation forest.
"""

from exposcope.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
