"""String expressions with Python ``str`` semantics (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()``: every kind of whitespace (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def py_capitalize(x) -> Column:
    """``str.capitalize()``: first character upper, the rest lower."""
    c = _c(x)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def first_words(x, n: int = 2) -> Column:
    """``' '.join(str.split()[:n])``."""
    return F.array_join(F.slice(F.split(py_strip(x), r"(?U)\s+"), 1, n), " ")


def standard_name(name: str) -> str:
    """Column-name normalisation: strip, lower case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")
