"""Cleaning, features and risk columns as ML pipeline stages (survey A15).

With these, one saved ``PipelineModel`` takes raw rows to scored rows: ``scoring_pipeline`` puts a fitted model between the
batch-mode stages, and gives what ``models.batch_score`` gives. ``StudentCleaner`` is the fit mode's state (medians,
modes, label dictionaries) as an Estimator, so what training learned from the table is saved beside the models
and applied to later rows. All parameters are writable; a stage is saved and loaded like any other.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .clean import (BROADCAST_LABELS, ImputeState, as_label_string, cap_outliers, clean_batch, encode_target, fit_categoricals, impute,
                    standardise_columns)
from .features import add_features
from .ordered import exact_quantiles
from .score import attach_risk

_RAW = "_raw"


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """A stage that is saved with its parameters."""


class RawKeeper(Transformer, _Stage):
    """Packs the columns as they came into one struct, which ``RiskColumns`` unpacks again."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(_RAW))


class BatchCleaner(Transformer, _Stage):
    """Target dropped, names standardised, model features to numbers."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return clean_batch(df, encode=False)


class FeatureBuilder(Transformer, _Stage):
    """C1-C5, then every model feature as a double (0 where its column is absent)."""

    features = Param(Params._dummy(), "features", "model features in order", TypeConverters.toListString)

    @keyword_only
    def __init__(self, features=None):
        super().__init__()
        self._setDefault(features=list(cfg.MODEL_FEATURES))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        df = add_features(df)
        return df.withColumns({c: (F.col(c).cast("double") if c in df.columns else F.lit(0.0)) for c in self.getOrDefault(self.features)})


class RiskColumns(Transformer, _Stage):
    """F2-F4 from the model's probability, beside the columns that ``RawKeeper`` kept."""

    high = Param(Params._dummy(), "high", "least fail probability of the high band", TypeConverters.toFloat)
    medium = Param(Params._dummy(), "medium", "least fail probability of the medium band", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, high=None, medium=None):
        super().__init__()
        self._setDefault(high=float(cfg.RISK_HIGH), medium=float(cfg.RISK_MEDIUM))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        p = vector_to_array(F.col("probability"))
        out = df.select(f"{_RAW}.*", p[0].alias("_fail"), p[1].alias("_pass"))
        return attach_risk(out, "_fail", "_pass", cfg.RiskParams(high=self.getOrDefault(self.high), medium=self.getOrDefault(self.medium)))


def scoring_pipeline(model: PipelineModel) -> PipelineModel:
    """Raw rows to scored rows in one pipeline that can be saved."""
    return PipelineModel(stages=[RawKeeper(), BatchCleaner(), FeatureBuilder(), *model.stages, RiskColumns()])


class _CleanerParams(Params):
    numeric = Param(Params._dummy(), "numeric", "columns that get their median and are capped", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns that get their mode and a label code", TypeConverters.toListString)

    def _columns(self, df: DataFrame) -> tuple[list[str], list[str]]:
        return tuple([c for c in self.getOrDefault(p) if c in df.columns] for p in (self.numeric, self.categorical))


class StudentCleaner(Estimator, _CleanerParams, _Stage):
    """B4, B5, B8 fitted on standardised, de-duplicated rows (see ``clean.clean_fit``)."""

    @keyword_only
    def __init__(self, numeric=None, categorical=None):
        super().__init__()
        self._setDefault(numeric=list(cfg.NUMERIC_FEATURES), categorical=list(cfg.CATEGORICAL_FEATURES))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> StudentCleanerModel:
        df = standardise_columns(df)
        num, cat = self._columns(df)
        medians = {c: v[0.5] for c, v in exact_quantiles(df, num, [0.5]).items()}
        modes, found = fit_categoricals(df, cat)
        labels = {}
        for c, d in found.items():
            rows = d.orderBy("code").limit(BROADCAST_LABELS + 1).collect()
            if len(rows) > BROADCAST_LABELS:
                raise ValueError(f"{c} has more than {BROADCAST_LABELS} labels: keep its dictionary as a table (clean.fit_label_dictionary)")
            labels[c] = [r["value"] for r in rows]
        state = {"medians": {c: None if v != v else v for c, v in medians.items()}, "modes": modes, "labels": labels}
        out = StudentCleanerModel()
        return self._copyValues(out)._set(state=json.dumps(state))


class StudentCleanerModel(Model, _CleanerParams, _Stage):
    """Applies a fitted ``StudentCleaner``: medians and modes, capping, label codes (unseen: -1), the target's code."""

    state = Param(Params._dummy(), "state", "fitted medians, modes and labels as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numeric=list(cfg.NUMERIC_FEATURES), categorical=list(cfg.CATEGORICAL_FEATURES), state="{}")

    def _transform(self, df: DataFrame) -> DataFrame:
        df = standardise_columns(df)
        state = json.loads(self.getOrDefault(self.state))
        num, cat = self._columns(df)
        medians = {c: state["medians"].get(c) for c in num}
        df = cap_outliers(impute(df, ImputeState(medians, {c: state["modes"].get(c) for c in cat})))
        codes = {}
        for c in cat:  # at most BROADCAST_LABELS entries
            known = F.create_map(*[F.lit(x) for i, v in enumerate(state["labels"].get(c, [])) for x in (v, i)]) if state["labels"].get(c) else None
            codes[c] = F.coalesce(F.try_element_at(known, as_label_string(c)), F.lit(-1)) if known is not None else F.lit(-1)
        return encode_target(df.withColumns(codes) if codes else df)
