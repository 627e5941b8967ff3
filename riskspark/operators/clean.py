"""Cleaning and encoding operators (survey 2.B).

Three modes, as in the reference, chosen explicitly by the caller:

* ``fit``    -- names -> required check -> first-row dedup -> median/mode impute ->
               clip -> label-encode (fit) -> target encode;
* ``single`` -- names -> constant impute -> clip -> label-encode (apply);
* ``batch``  -- drop target -> names -> coerce-to-number-or-0 -> label-encode (refit on batch).

Fitted state (medians, modes, dictionaries) is small and lives on the driver
like any Spark ML model's parameters; fitting it is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import clip, nan_to_null, py_capitalize, py_strip, standard_name, to_double_or_zero
from .ordered import dense_codes, exact_quantiles, first_rows, running_totals


# -- B1 / B2 ---------------------------------------------------------------

def standardise_columns(df: DataFrame) -> DataFrame:
    """B1: strip, lower-case, spaces to underscores."""
    return df.toDF(*[standard_name(c) for c in df.columns])


def check_required(df: DataFrame, required=cfg.REQUIRED_COLUMNS) -> tuple[bool, list[str]]:
    """B2 (non-raising): (ok, missing columns in contract order). Schema only, no job."""
    missing = [c for c in required if c not in df.columns]
    return (not missing, missing)


def validate_required(df: DataFrame, required=cfg.REQUIRED_COLUMNS) -> DataFrame:
    """B2: raise listing every missing required column."""
    ok, missing = check_required(df, required)
    if not ok:
        raise ValueError(f"Missing required columns: {missing}")
    return df


# -- B3 --------------------------------------------------------------------

def with_row_ordinal(df: DataFrame, name: str = "row_ordinal") -> DataFrame:
    """Input order of freshly read files: path, place of the split in its file, row in the split.
    (Spark packs larger splits first, so the partition index alone is not file order.) Frames
    that were not read from files are numbered in partition order."""
    row = F.monotonically_increasing_id()
    try:
        return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.file_block_start", row.alias("row")))
    except AnalysisException:
        return df.withColumn(name, row)


def dedup_first(df: DataFrame, key: str = cfg.ID_COLUMN, order_col: str = "row_ordinal") -> DataFrame:
    """Keep the first row (smallest ``order_col``) per key; NULL keys form one group, rows
    without an order value come last."""
    return first_rows(df, key, order_col)


# -- B4 / B5 / B6 ----------------------------------------------------------

@dataclass
class ImputeState:
    numeric: dict = field(default_factory=dict)      # column -> median
    categorical: dict = field(default_factory=dict)  # column -> mode


def column_modes(df: DataFrame, cols) -> dict:
    """Most frequent value, smallest on ties (pandas ``mode()[0]``)."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_s")).select("_s.column", "_s.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), "value")).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}


def fit_imputer(df: DataFrame, numeric=cfg.NUMERIC_FEATURES,
                categorical=cfg.CATEGORICAL_FEATURES) -> ImputeState:
    """B4/B5 fit: exact medians (distributed order statistics) and modes."""
    num = [c for c in numeric if c in df.columns]
    cat = [c for c in categorical if c in df.columns]
    med = exact_quantiles(df, num, [0.5]) if num else {}
    return ImputeState({c: med[c][0.5] for c in num}, column_modes(df, cat))


def impute(df: DataFrame, state: ImputeState) -> DataFrame:
    """B4/B5 apply. Numeric columns that were imputed become double (pandas float64)."""
    exprs = {}
    for c, v in state.numeric.items():
        x = nan_to_null(F.col(c).try_cast("double"))
        exprs[c] = x if v is None or v != v else F.coalesce(x, F.lit(float(v)))
    for c, v in state.categorical.items():
        exprs[c] = F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c)
    return df.withColumns(exprs) if exprs else df


def impute_single(df: DataFrame, numeric=cfg.NUMERIC_FEATURES,
                  categorical=cfg.CATEGORICAL_FEATURES) -> DataFrame:
    """Numeric -> 0.0, categorical -> 'Unknown' (single-record mode)."""
    exprs = {c: F.coalesce(nan_to_null(F.col(c).try_cast("double")), F.lit(cfg.SINGLE_NUMERIC_FILL))
             for c in numeric if c in df.columns}
    exprs.update({c: F.coalesce(F.col(c), F.lit(cfg.SINGLE_CATEGORICAL_FILL))
                  for c in categorical if c in df.columns})
    return df.withColumns(exprs) if exprs else df


# -- B7 --------------------------------------------------------------------

def cap_outliers(df: DataFrame, ranges=cfg.NUMERIC_RANGES) -> DataFrame:
    """Clip each present column to its valid range (NULL stays NULL)."""
    exprs = {c: clip(c, lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns}
    return df.withColumns(exprs) if exprs else df


def out_of_range_report(df: DataFrame, ranges=cfg.NUMERIC_RANGES) -> DataFrame:
    """B7 report: per column, how many values lie below / above the valid range."""
    cols = [c for c in ranges if c in df.columns]
    aggs = []
    for c in cols:
        lo, hi = ranges[c]
        aggs += [F.count_if(F.col(c) < lo).alias(f"{c}__below"), F.count_if(F.col(c) > hi).alias(f"{c}__above")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(ranges[c][0])).alias("lower"),
                 F.lit(float(ranges[c][1])).alias("upper"),
                 F.col(f"{c}__below").alias("n_below"), F.col(f"{c}__above").alias("n_above"))
        for c in cols])).alias("r")).select("r.*")


# -- B8 / B9 ---------------------------------------------------------------

def as_label_string(c: str) -> F.Column:
    """pandas ``astype(str)`` of a column that may hold NaN."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def fit_label_dictionary(df: DataFrame, col: str) -> DataFrame:
    """B8 fit: (value, code) with codes = rank of the string value, from 0."""
    return dense_codes(df.select(as_label_string(col).alias("value")), "value")


def apply_label_dictionary(df: DataFrame, col: str, dictionary: DataFrame | None,
                           unseen: int = -1) -> DataFrame:
    """Replace ``col`` by its code; unseen values (or no dictionary) give -1.

    Left join on the label; the dictionary is an aggregate whose runtime size
    AQE checks before choosing a broadcast, with a shuffle join beyond it.
    """
    if dictionary is None:
        return df.withColumn(col, F.lit(unseen))
    d = dictionary.select(F.col("value").alias("_lbl"), F.col("code").alias("_code"))
    out = df.withColumn("_lbl_key", as_label_string(col)).join(d, F.col("_lbl_key") == F.col("_lbl"), "left")
    return out.withColumn(col, F.coalesce(F.col("_code"), F.lit(unseen))).drop("_lbl_key", "_lbl", "_code")


def _label_counts(df: DataFrame, cols, null_label: str | None = None) -> DataFrame:
    """(column, value, n) over several categorical columns in one partial aggregate; NULL kept,
    or counted as ``null_label``."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(null_label).cast("string"))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in cols
    ])).alias("_s")).select("_s.column", "_s.value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


#: a dictionary of at most so many labels is sent to the tasks that apply it; AQE picks the join beyond
BROADCAST_LABELS = 100_000


def fit_categoricals(df: DataFrame, cols=cfg.CATEGORICAL_FEATURES, with_modes: bool = True,
                     num_partitions: int | None = None) -> tuple[dict, dict]:
    """B5 + B8 fitted together: (modes, dictionaries) from one aggregate, read once.

    ``with_modes``: dictionaries describe the column after B5 imputation (NULL
    becomes the mode), as in the *fit* mode; otherwise NULL is the label 'nan',
    as in batch refits. Labels are ranked on the executors; the driver gets one
    (mode, label count) row per column.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}, {}
    counts = _label_counts(df, cols, None if with_modes else "nan")
    label = F.col("value").isNotNull()
    ranked = running_totals(counts.withColumn("_one", label.cast("int")), ["value"], ["_one"],
                            group_cols=["column"], num_partitions=num_partitions)
    top = F.min(F.when(label, F.struct((-F.col("n")).alias("neg_n"), "value")))
    found = {r["column"]: r for r in ranked.groupBy("column").agg(top.alias("top"), F.max("_one_cum").alias("labels")).collect()}
    modes, dictionaries = {}, {}
    for c in cols:
        codes = ranked.where(label & (F.col("column") == c)).select("value", (F.col("_one_cum") - 1).cast("int").alias("code"))
        if c in found and found[c]["top"] is None:   # NULL alone: 'nan' is the only label
            codes = df.sparkSession.createDataFrame([("nan", 0)], "value string, code int")
        elif c in found and with_modes:
            modes[c] = found[c]["top"]["value"]
        small = c not in found or found[c]["labels"] <= BROADCAST_LABELS
        dictionaries[c] = F.broadcast(codes) if small else codes
    return modes, dictionaries


def encode_categoricals(df: DataFrame, cols=cfg.CATEGORICAL_FEATURES, dictionaries: dict | None = None):
    """B8 fit+apply (``dictionaries`` None) or B9 apply. Returns (frame, dictionaries)."""
    if dictionaries is None:
        _, fitted = fit_categoricals(df, cols, with_modes=False)
    else:
        fitted = dictionaries
    for c in cols:
        if c in df.columns:
            df = apply_label_dictionary(df, c, fitted.get(c))
    return df, fitted


# -- B10 -------------------------------------------------------------------

def normalised_label(c: str = cfg.TARGET_COLUMN) -> F.Column:
    return py_capitalize(py_strip(F.col(c)))


def encode_target(df: DataFrame, target: str = cfg.TARGET_COLUMN) -> DataFrame:
    """Strip + capitalise; 'Pass' -> 1, everything else (NULL included) -> 0."""
    if target not in df.columns:
        return df
    return df.withColumn(target, F.coalesce((normalised_label(target) == "Pass").cast("int"), F.lit(0)))


# -- B11-B15 ---------------------------------------------------------------

def coerce_batch(df: DataFrame, features=cfg.MODEL_FEATURES) -> DataFrame:
    """Any model feature present -> number, non-numeric/NULL -> 0 (no clip, no median)."""
    exprs = {c: to_double_or_zero(c) for c in features if c in df.columns}
    return df.withColumns(exprs) if exprs else df


def drop_target(df: DataFrame, target: str = cfg.TARGET_COLUMN) -> DataFrame:
    """B12."""
    return df.drop(target) if target in df.columns else df


def select_features(df: DataFrame, features=cfg.MODEL_FEATURES, keep=()) -> DataFrame:
    """Features in contract order, absent ones as 0.0."""
    return df.select(*keep, *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c)
                              for c in features])


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a NULL/NaN in any of ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            cond = cond & ~F.isnan(c)
    return df.filter(cond)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


# -- modes -----------------------------------------------------------------

@dataclass
class CleanState:
    impute: ImputeState
    dictionaries: dict


def clean_fit(df: DataFrame, params: cfg.CleanParams = cfg.CleanParams(),
              order_col: str = "row_ordinal") -> tuple[DataFrame, CleanState]:
    """Training-mode cleaning (B1 -> B2 -> B3 -> B4/B5 -> B7 -> B8 -> B10)."""
    df = validate_required(standardise_columns(df), params.required)
    if order_col not in df.columns:
        df = with_row_ordinal(df, order_col)
    # three scans fit the statistics: the rows are held (memory, then disk) until the last one is done
    df = dedup_first(df, params.id_col, order_col)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        num = [c for c in params.numeric if c in df.columns]
        med = exact_quantiles(held, num, [0.5]) if num else {}
        # modes and label dictionaries in one pass (dictionaries of the imputed columns)
        modes, dicts = fit_categoricals(held, params.categorical, with_modes=True)
    finally:
        held.unpersist()
    state = ImputeState({c: med[c][0.5] for c in num}, modes)
    df = cap_outliers(impute(df, state), params.ranges)
    df, _ = encode_categoricals(df, params.categorical, dicts)
    df = encode_target(df, params.target)
    return df, CleanState(state, dicts)


def clean_single(df: DataFrame, dictionaries: dict | None = None,
                 params: cfg.CleanParams = cfg.CleanParams()) -> DataFrame:
    """Record-mode cleaning (B1 -> B6 -> B7 -> B9); any number of rows, each row on its own."""
    df = impute_single(standardise_columns(df), params.numeric, params.categorical)
    df = cap_outliers(df, params.ranges)
    df, _ = encode_categoricals(df, params.categorical, dictionaries or {})
    return df


def clean_batch(df: DataFrame, params: cfg.CleanParams = cfg.CleanParams(), encode: bool = True) -> DataFrame:
    """Batch-inference cleaning (B12 -> B1 -> B11 -> B8 refit on the batch, where the codes are read)."""
    df = coerce_batch(standardise_columns(drop_target(df, params.target)))
    return encode_categoricals(df, params.categorical)[0] if encode else df
