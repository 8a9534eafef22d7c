"""encore: play-history analytics on Spark.

Raw play logs -> profiling (EDA) -> cleaned music plays (silver) -> listening
sessions -> gold views, each stage a DataFrame job built from built-in Spark
expressions and keyed by account so the work spreads over the cluster.
"""

from encore.config import PipelineConfig

__all__ = ["PipelineConfig"]
