"""Training and selection of the three classifiers with MLlib (survey 2.D, E6, F1, A15).

* split  -- stratified 80/20 by exact per-class ranks of ``xxhash64(id, seed)``
            (distributed running totals, so no class is ever sorted in one task);
* folds  -- stratified: the training rank within a class modulo 5;
* models -- ``Pipeline(VectorAssembler, StandardScaler, classifier)``;
* CV     -- stratified k-fold on the fold column, F1 of class 1, mean and population std;
* select -- strictly highest rounded CV-F1, first in model order on ties.

The prepared training frame is checkpointed to the shared folder (lineage cut,
survives executor loss) and cached, since every fit re-reads it. All folds and the
refit of a tree model are grown in the same jobs (``trees.py``); the logistic regressions and
the two tree models run beside each other from a driver thread pool.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..session import scratch_path
from .clean import clean_batch, drop_incomplete, select_features
from .evaluate import metrics_table
from .features import add_features
from .ordered import running_totals
from .score import attach_risk
from .trees import BoostedLearner, ForestLearner

LR, RF, GBT = cfg.MODEL_ORDER


@dataclass
class TrainParams:
    features: list = field(default_factory=lambda: list(cfg.MODEL_FEATURES))
    label: str = cfg.TARGET_COLUMN
    key: str = cfg.ID_COLUMN
    test_size: float = cfg.TEST_SIZE
    folds: int = cfg.CV_FOLDS
    seed: int = cfg.RANDOM_STATE
    lr_max_iter: int = cfg.LR_PARAMS["max_iter"]
    lr_c: float = cfg.LR_PARAMS["C"]
    rf_trees: int = cfg.RF_PARAMS["n_estimators"]
    rf_depth: int = cfg.RF_PARAMS["max_depth"]
    rf_min_per_node: int = 2          # closest to min_samples_split=5 (no exact MLlib equal)
    gbt_iter: int = cfg.GBT_PARAMS["n_estimators"]
    gbt_depth: int = cfg.GBT_PARAMS["max_depth"]
    gbt_step: float = cfg.GBT_PARAMS["learning_rate"]
    models: tuple = tuple(cfg.MODEL_ORDER)
    parallel_fits: int = cfg.PARALLEL_FITS   # fits that run beside each other (all folds of a tree model are one)


# -- D1 / D6 -----------------------------------------------------------------

def stratified_split(df: DataFrame, params: TrainParams = TrainParams()) -> DataFrame:
    """D1 + D6: adds ``split`` ('train' / 'test') and ``fold`` (0..k-1 for train, -1 for test).

    Per class, rows are ranked by ``xxhash64(key, seed)``; the first
    round(test_size * n_class) are test. Row membership differs from NumPy's RNG;
    class proportions match.
    """
    lab = params.label
    h = df.withColumn("_h", F.xxhash64(F.col(params.key), F.lit(params.seed))).withColumn("_one", F.lit(1))
    ranked = running_totals(h, ["_h", params.key], ["_one"], group_cols=[lab])
    # per-class test quota (Python's round = half-even), joined in-plan: one row per class
    quota = ranked.groupBy(lab).agg(F.bround(F.lit(float(params.test_size)) * F.count(F.lit(1)), 0)
                                .cast("long").alias("_n_test"))
    rank, n_test = F.col("_one_cum"), F.col("_n_test")
    is_test = rank <= n_test
    return ranked.join(F.broadcast(quota), lab).select(
        *df.columns,
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(is_test, F.lit(-1)).otherwise(((rank - n_test - 1) % params.folds).cast("int")).alias("fold"))


# -- D2-D5 -------------------------------------------------------------------

@dataclass
class Standardiser:
    """D2 standalone scaler: per-feature mean and population sd (0 sd -> scale 1)."""
    features: list
    means: dict
    scales: dict

    def frame(self, spark) -> DataFrame:
        """(feature, mean, scale) rows, in feature order."""
        return spark.createDataFrame([(i, f, self.means[f], self.scales[f]) for i, f in enumerate(self.features)],
                                     "position int, feature string, mean double, scale double")


def fit_standardiser(df: DataFrame, features=cfg.MODEL_FEATURES) -> Standardiser:
    """D2 fit: one aggregate gives mean and population sd of every feature (NULLs ignored).

    The reference stores its scaler on its own as well as inside the pipelines; the
    pipelines' MLlib scaler divides by the sample sd, this one by the population sd
    (scikit-learn's). The fitted state is 2 scalars per feature.
    """
    feats = list(features)
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(feats)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(feats)]).first()
    means = {c: row[f"m{i}"] for i, c in enumerate(feats)}
    # zero (or undefined) spread leaves the centred value unscaled, as scikit-learn does
    scales = {c: (row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(feats)}
    return Standardiser(feats, means, scales)


def standardise(df: DataFrame, st: Standardiser) -> DataFrame:
    """D2 apply: ``(x - mean) / scale`` per feature as column expressions."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(st.means[c])) / F.lit(float(st.scales[c]))
                           for c in st.features if c in df.columns and st.means[c] is not None})


def feature_stages(params: TrainParams) -> list:
    """What all models' pipelines begin with."""
    return [VectorAssembler(inputCols=params.features, outputCol="features_raw", handleInvalid="keep"),
            StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)]


def classifier(name: str, params: TrainParams, n_train: int):
    if name == LR:
        clf = LogisticRegression(featuresCol="features", labelCol=params.label, maxIter=params.lr_max_iter,
                                 regParam=1.0 / (params.lr_c * max(n_train, 1)), elasticNetParam=0.0,
                                 standardization=False)
    elif name == RF:
        clf = ForestLearner(featuresCol="features", labelCol=params.label, numTrees=params.rf_trees,
                            maxDepth=params.rf_depth, minInstancesPerNode=params.rf_min_per_node,
                            maxBins=128, seed=params.seed)
    elif name == GBT:
        clf = BoostedLearner(featuresCol="features", labelCol=params.label, maxIter=params.gbt_iter,
                             maxDepth=params.gbt_depth, stepSize=params.gbt_step, seed=params.seed)
    else:
        raise ValueError(name)
    return clf


def build_pipeline(name: str, params: TrainParams, n_train: int) -> Pipeline:
    return Pipeline(stages=[*feature_stages(params), classifier(name, params, n_train)])


def f1_evaluator(label: str) -> MulticlassClassificationEvaluator:
    """F1 of class 1 (MLlib's default ``f1`` is the weighted average)."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)


@dataclass
class TrainResult:
    models: dict              # name -> fitted PipelineModel (refit on the whole training split)
    cv: dict                  # name -> (mean, population std) of fold F1
    metrics: DataFrame        # one row per model (E7 + CV columns + is_best)
    best_name: str
    train: DataFrame
    test: DataFrame


def prepare_training(featured: DataFrame, params: TrainParams = TrainParams()) -> DataFrame:
    """B13 + B14 + D1/D6 on a cleaned, feature-engineered table; checkpointed."""
    cols = [params.key, *params.features, params.label]
    df = drop_incomplete(select_features(featured, params.features, keep=[params.key, params.label])
                         .select(*cols), params.features + [params.label])
    df = df.withColumn(params.label, F.col(params.label).cast("double"))
    split = stratified_split(df, params)
    # The split's ranks come from windows partitioned by class (2 groups) or from range
    # partitions, so the result may sit in a few skewed partitions. Every fit, CV fold and
    # scoring pass reads this frame: rebalance it before the lineage cut, letting AQE size
    # the partitions (advisory bytes): one for a small frame, evenly sized ones at scale.
    return split.hint("rebalance").checkpoint(eager=True)


class FoldRows:
    """The rows that a fold's models learn from: assembled and scaled once, held (memory, then disk) until ``release``."""

    def __init__(self, train: DataFrame, params: TrainParams, n_rows: int) -> None:
        self.params, self.n_rows = params, n_rows
        shared = Pipeline(stages=feature_stages(params)).fit(train)
        self.stages = shared.stages
        self.data = shared.transform(train).select("features", params.label).persist()

    def model(self, fitted) -> PipelineModel:
        """What ``build_pipeline`` gives when it is fitted on the rows."""
        return PipelineModel([*self.stages, fitted])

    def release(self) -> None:
        self.data.unpersist()


def fit_order(params: TrainParams) -> list:
    """(model, fold or None for the refit) of every fit, slowest models first, so that no long one is left for the end.

    Boosted trees wait for many short jobs, forests keep the cores busy: they take turns, half a pool of each."""
    half = max(1, params.parallel_fits // 2)
    fits = {m: [(m, k) for k in (None, *range(params.folds))] for m in params.models}
    slow = [m for m in (GBT, RF) if m in fits]
    turns = [f for a in range(0, params.folds + 1, half) for m in slow for f in fits[m][a:a + half]]
    return turns + [f for m in params.models if m not in slow for f in fits[m]]


def fit_folds(name: str, params: TrainParams, rows: list) -> list:
    """The model ``name`` of every set of rows, in order; a tree model's are grown together."""
    if name == LR:
        return [r.model(classifier(name, params, r.n_rows).fit(r.data)) for r in rows]
    return [r.model(m) for r, m in zip(rows, classifier(name, params, 0).fit_all([r.data for r in rows]))]


def cross_validate(train: DataFrame, params: TrainParams = TrainParams()):
    """Stratified k-fold CV of every model, plus the refit on the whole training split.

    The folds' rows are prepared first; then the models (see ``fit_folds``) and after them the folds'
    evaluations are submitted from a driver thread pool of ``parallel_fits``. Each fold's logistic
    regression gets the penalty for its own size (``1 / (C * n_fold)``), as a
    fresh estimator per fold would. Returns (refitted models, {name: (mean, pop std)}).
    """
    lab = params.label
    sizes = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train = sum(sizes.values())
    evaluator = f1_evaluator(lab)
    folds = [*range(params.folds), None]              # None: the refit

    def prepared(k):
        return FoldRows(train, params, n_train) if k is None else \
            FoldRows(train.filter(F.col("fold") != k), params, n_train - sizes.get(k, 0))

    with ThreadPoolExecutor(max_workers=max(1, params.parallel_fits)) as pool:
        rows = list(pool.map(prepared, folds))
        try:
            slowest_first = list(dict.fromkeys(m for m, _ in fit_order(params)))
            fitted = dict(zip(slowest_first, pool.map(lambda m: fit_folds(m, params, rows), slowest_first)))
        finally:
            for r in rows:
                r.release()
        held_out = [(m, k) for m, k in fit_order(params) if k is not None]
        scores = dict(zip(held_out, pool.map(
            lambda t: evaluator.evaluate(fitted[t[0]][t[1]].transform(train.filter(F.col("fold") == t[1]))), held_out)))
    cv = {}
    for m in params.models:
        of_m = np.array([scores[m, k] for k in range(params.folds)])
        cv[m] = (float(of_m.mean()), float(of_m.std()))       # population std (ddof 0)
    return {m: fitted[m][-1] for m in params.models}, cv


def train_and_select(featured: DataFrame, params: TrainParams = TrainParams()) -> TrainResult:
    """Split, cross-validate each model, refit, test metrics, pick the best."""
    data = prepare_training(featured, params)
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    models, cv = cross_validate(train, params)
    r4 = lambda x: float(round(x, 4)) if x == x else x
    best_name, best = None, -1.0
    for n in params.models:                      # strictly greater: first in order wins ties
        if r4(cv[n][0]) > best:
            best_name, best = n, r4(cv[n][0])
    # held-out metrics of all models in one grouped aggregate (E7), plus the CV columns
    metrics = metrics_table({n: scored_frame(models[n], test, params.label) for n in params.models},
                            params.label, "prediction", "score")
    cv_rows = featured.sparkSession.createDataFrame(
        [(i, r4(cv[n][0]), r4(cv[n][1]), n == best_name) for i, n in enumerate(params.models)],
        "model_order int, cv_f1_mean double, cv_f1_std double, is_best boolean")
    metrics = metrics.join(cv_rows, "model_order").orderBy("model_order")
    return TrainResult(models, cv, metrics, best_name, train, test)


def scored_frame(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """(label, prediction, score = P(class 1)) for evaluation."""
    out = model.transform(df)
    return out.select(F.col(label).cast("int").alias(label), F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))


# -- E6 ------------------------------------------------------------------------

def importance_model(models: dict) -> PipelineModel | None:
    """The forest, else any other model that has importances, else None."""
    return next((models[m] for m in (RF, *models) if m in models and hasattr(models[m].stages[-1], "featureImportances")), None)


def feature_importances(model: PipelineModel, features=cfg.MODEL_FEATURES, top_n: int = cfg.TOP_IMPORTANCES):
    """A tree ensemble's importances as (feature, importance), largest first, top n."""
    clf = model.stages[-1]
    imp = clf.featureImportances.toArray().tolist()
    return list(sorted(zip(features, imp), key=lambda t: -t[1]))[:top_n]


# -- F1 -----------------------------------------------------------------------

def batch_score(model: PipelineModel, raw: DataFrame, features=cfg.MODEL_FEATURES) -> DataFrame:
    """batch-mode cleaning + features + model; raw columns kept, six scoring columns added.

    The raw columns ride along under private names through the one lineage (no
    self-join on a generated row id).
    """
    tagged = raw.select(*[F.col(c).alias(f"__raw_{i}") for i, c in enumerate(raw.columns)], *raw.columns)
    prepared = add_features(clean_batch(tagged, encode=False))   # no model reads the label codes
    prepared = prepared.withColumns({c: (F.col(c).cast("double") if c in prepared.columns else F.lit(0.0))
                                     for c in features})
    p = vector_to_array(F.col("probability"))
    out = model.transform(prepared).select(
        *[F.col(f"__raw_{i}").alias(c) for i, c in enumerate(raw.columns)],
        p[0].alias("_fail"), p[1].alias("_pass"))
    return attach_risk(out, "_fail", "_pass")


# -- A15 ----------------------------------------------------------------------

def save_models(models: dict, base: str | None = None, spark=None) -> dict:
    """Native MLlib persistence in the shared folder; returns name -> path."""
    paths = {}
    for n, m in models.items():
        path = (base or scratch_path(spark, "models")) + "/" + n.lower().replace(" ", "_")
        m.write().overwrite().save(path)
        paths[n] = path
    return paths


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
