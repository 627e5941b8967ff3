"""Null-safe numeric column expressions with NumPy/pandas semantics (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def np_round(x, decimals: int = 0) -> Column:
    """NumPy/pandas rounding: scale, round half to even, unscale.

    Spark's ``round`` is half-up (0.125 -> 0.13); NumPy gives 0.12.
    """
    scale = float(10 ** decimals)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def clip(x, lo=None, hi=None) -> Column:
    """pandas ``clip``: NULL stays NULL (``greatest(NULL, lo)`` would give ``lo``)."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNull(), c).otherwise(out)


def nan_to_null(x) -> Column:
    """pandas treats NaN as missing; Spark orders NaN above every number."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_ratio(num, den) -> Column:
    """num / den, 0 when den is 0 (sklearn ``zero_division=0``)."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(0.0))


def to_double_or_zero(x) -> Column:
    """pandas ``to_numeric(errors='coerce').fillna(0)``."""
    c = _c(x)
    return F.coalesce(nan_to_null(c.try_cast("double")), F.lit(0.0))


def fixed1(x) -> Column:
    """Python ``'%.1f' % x``: exact binary value, half-to-even (``format_number`` does the same)."""
    return F.regexp_replace(F.format_number(_c(x), 1), ",", "")


def trunc_int_str(x) -> Column:
    """Python ``str(int(x))``: truncation toward zero."""
    return _c(x).cast("long").cast("string")
