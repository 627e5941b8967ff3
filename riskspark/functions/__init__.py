"""Column-expression helpers (JVM-side, codegen friendly)."""

from .numeric import clip, fixed1, nan_to_null, np_round, safe_ratio, to_double_or_zero, trunc_int_str
from .text import first_words, py_capitalize, py_strip, standard_name

__all__ = [
    "clip", "fixed1", "nan_to_null", "np_round", "safe_ratio", "to_double_or_zero", "trunc_int_str",
    "first_words", "py_capitalize", "py_strip", "standard_name",
]
