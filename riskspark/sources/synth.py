"""Seeded sampling (A14), partition-independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg


def seeded_sample(df: DataFrame, k: int, key: str, seed: int = cfg.RANDOM_STATE,
                  drop=(cfg.TARGET_COLUMN,)) -> DataFrame:
    """K rows chosen by hash order (top-k, the limit is the feature); target dropped."""
    out = df.drop(*[c for c in drop if c in df.columns])
    return out.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(k)
