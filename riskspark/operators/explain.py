"""Feature attributions (survey 2.H).

* Linear models: exact Shapley values in closed form,
  ``phi_j = a_j * (x_j - mean_background(x_j))`` with ``a_j`` the weight on the raw
  feature (for a scaled logistic regression ``a_j = w_j / sd_j``, log-odds units).
  Pure column expressions; the background means are one aggregate.
* Tree ensembles: path-dependent TreeSHAP (``treeshap.py``) in ``mapInPandas`` over
  Arrow batches, with the fitted trees' node tables broadcast (their size is the
  model's, not the data's).

* Any probability function: permutation Shapley values against a background table
  (``sampled_attributions``), in probability space, with a stated error.

Long form (key, feature, value) feeds the global ranking (H2), the per-student
sorted view (H3) and the waterfall (H4); the per-row views use array functions,
so they never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import np_round


def background_means(background: DataFrame, features) -> dict:
    """Mean of each feature over the background frame (one aggregate, a few scalars)."""
    row = background.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: row[c] for c in features}


def linear_attributions(df: DataFrame, weights: dict, means: dict, key: str = cfg.ID_COLUMN,
                        base_intercept: float = 0.0) -> DataFrame:
    """H1 (linear): adds ``attributions`` = ARRAY<STRUCT<feature, value>> and ``base_value``."""
    items = [F.struct(F.lit(f).alias("feature"),
                      (F.lit(float(w)) * (F.col(f).cast("double") - F.lit(float(means[f])))).alias("value"))
             for f, w in weights.items()]
    base = base_intercept + sum(float(w) * float(means[f]) for f, w in weights.items())
    return df.select(key, F.array(*items).alias("attributions"), F.lit(base).alias("base_value"))


def lr_effective_weights(model, features=cfg.MODEL_FEATURES) -> tuple[dict, dict, float]:
    """(weights on raw features, scaler means, intercept in raw units) of a scaled LR pipeline."""
    scaler, lr = model.stages[-2], model.stages[-1]
    mu, sd = scaler.mean.toArray(), scaler.std.toArray()
    w = lr.coefficients.toArray()
    eff = {f: (w[i] / sd[i] if sd[i] != 0 else 0.0) for i, f in enumerate(features)}
    intercept = lr.intercept - sum(eff[f] * mu[i] for i, f in enumerate(features))
    return eff, {f: mu[i] for i, f in enumerate(features)}, intercept


def model_linear_attributions(model, df: DataFrame, background: DataFrame, features=cfg.MODEL_FEATURES,
                              key: str = cfg.ID_COLUMN) -> DataFrame:
    """H1 for a fitted scaled logistic-regression pipeline, background = e.g. the training split."""
    eff, _, intercept = lr_effective_weights(model, features)
    return linear_attributions(df, eff, background_means(background, features), key, intercept)


# -- any model, by sampling ------------------------------------------------------

def background_table(background: DataFrame, features, rows: int = 64, key: str = cfg.ID_COLUMN):
    """At most ``rows`` complete rows of the background (the first by a hash of their key) as a matrix."""
    import numpy as np

    from .clean import drop_incomplete

    feats = [F.col(c).cast("double").alias(c) for c in features]
    some = drop_incomplete(background.select(key, *feats), list(features)).orderBy(F.xxhash64(key), *features).limit(rows).collect()
    return np.array([[r[c] for c in features] for r in some], dtype=float).reshape(-1, len(features))


def logistic_probability(model, features=cfg.MODEL_FEATURES):
    """P(class 1) of a scaled logistic-regression pipeline as a function of a matrix of raw features."""
    import numpy as np

    eff, _, intercept = lr_effective_weights(model, features)
    w = np.array([eff[f] for f in features])
    return lambda x: 1.0 / (1.0 + np.exp(-np.clip(x @ w + intercept, -700, 700)))


def permutation_shapley(fn, x, background, pairs: int, seed: int = 42):
    """(values, standard errors, base) of the rows of ``x``: Shapley values of ``fn`` with absent features taken from
    the background rows.

    Each of ``pairs`` random orders is walked forwards and backwards (which cancels the first-order error); features
    are switched on one by one and what each step adds, averaged over the background, is the feature's. So values
    add up to ``fn(x)`` minus the base whatever the orders; their error is that of the mean over pairs."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    n, m = x.shape
    b = len(background)
    start = np.broadcast_to(background[None], (n, b, m))
    base = float(fn(background).mean())
    total, square = np.zeros((n, m)), np.zeros((n, m))
    for _ in range(pairs):
        order = rng.permutation(m)
        got = np.zeros((n, m))
        for walk in (order, order[::-1]):
            z = start.copy()
            before = np.full(n, base)
            for j in walk:
                z[:, :, j] = x[:, None, j]
                now = fn(z.reshape(-1, m)).reshape(n, b).mean(axis=1)
                got[:, j] += (now - before) / 2
                before = now
        total += got
        square += got * got
    mean = total / pairs
    spread = np.maximum(square / pairs - mean * mean, 0.0)
    return mean, np.sqrt(spread / max(pairs - 1, 1)), base


def sampled_attributions(fn, df: DataFrame, background, features=cfg.MODEL_FEATURES, key: str = cfg.ID_COLUMN,
                         pairs: int = 16, seed: int = 42, rows_at_once: int = 256) -> DataFrame:
    """H1 (any model, probability space): permutation Shapley values of ``fn`` (matrix -> probabilities).

    ``background``: a matrix (see ``background_table``). Adds ``attributions`` = ARRAY<STRUCT<feature, value, error>>
    (error: the value's standard error) and ``base_value``. All rows use the same orders, so results do not
    depend on partitions. A row with a missing feature has no attributions (empty array)."""
    import numpy as np
    import pandas as pd

    spark, names, back = df.sparkSession, list(features), background  # the model and the background's rows go with the task
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def batches(it):
        for pdf in it:
            for at in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[at:at + rows_at_once]
                x = part[names].to_numpy(float)
                ok = ~np.isnan(x).any(axis=1) & (len(back) > 0)
                value = error = np.zeros((0, len(names)))
                base = np.nan
                if ok.any():
                    value, error, base = permutation_shapley(fn, x[ok], back, pairs, seed)
                place = np.cumsum(ok) - 1
                yield pd.DataFrame({key: part[key].to_numpy(), "value": [value[p].tolist() if o else [] for p, o in zip(place, ok)],
                                    "error": [error[p].tolist() if o else [] for p, o in zip(place, ok)], "base_value": base})

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, value array<double>, error array<double>, base_value double"
    label = F.array(*[F.lit(f) for f in names])
    zipped = F.transform(F.arrays_zip("value", "error"), lambda v, i: F.struct(F.get(label, i).alias("feature"), v.value.alias("value"), v.error.alias("error")))
    return rows.mapInPandas(batches, schema).select(key, zipped.alias("attributions"), "base_value")


def attributions_long(attr: DataFrame, key: str = cfg.ID_COLUMN) -> DataFrame:
    return attr.select(key, F.inline("attributions"))


def global_importance(attr: DataFrame, key: str = cfg.ID_COLUMN, decimals: int = 4) -> DataFrame:
    """H2: mean |value| per feature (``decimals`` places) and its rank (1 = most important, ties by
    name). The window holds one row per feature."""
    imp = attributions_long(attr, key).groupBy("feature").agg(np_round(F.avg(F.abs("value")), decimals).alias("importance"))
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def sorted_contributions(attr: DataFrame, key: str = cfg.ID_COLUMN, decimals: int = 4) -> DataFrame:
    """H3: each row's contributions rounded, largest value first (ties by feature name)."""
    rounded = F.transform("attributions", lambda s: F.struct(
        np_round(s["value"], decimals).alias("value"), s["feature"].alias("feature")))
    ordered = F.array_sort(rounded, lambda a, b: F.when(a["value"] > b["value"], -1)
                           .when(a["value"] < b["value"], 1)
                           .otherwise(F.when(a["feature"] < b["feature"], -1)
                                      .when(a["feature"] > b["feature"], 1).otherwise(0)))
    return attr.select(key, F.posexplode(ordered).alias("position", "c")).select(
        key, "position", F.col("c.feature").alias("feature"), F.col("c.value").alias("shap_value"))


def waterfall(attr: DataFrame, key: str = cfg.ID_COLUMN, max_display: int = cfg.WATERFALL_MAX_DISPLAY) -> DataFrame:
    """H4: base value, then features by |value| descending; beyond ``max_display - 1`` the rest
    is one "N other features" bar when there are more than ``max_display`` features."""
    by_abs = F.array_sort("attributions", lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                          .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                          .otherwise(F.when(a["feature"] < b["feature"], -1)
                                     .when(a["feature"] > b["feature"], 1).otherwise(0)))
    n = F.size(by_abs)
    keep = max_display - 1
    rest = F.slice(by_abs, F.lit(keep + 1), F.greatest(n - keep, F.lit(0)))
    other = F.struct(F.concat((n - keep).cast("string"), F.lit(" other features")).alias("feature"),
                     F.aggregate(rest, F.lit(0.0), lambda acc, s: acc + s["value"]).alias("value"))
    bars = F.when(n > max_display, F.concat(F.slice(by_abs, 1, keep), F.array(other))).otherwise(by_abs)
    return attr.select(key, "base_value", F.posexplode(bars).alias("position", "b")).select(
        key, "base_value", "position", F.col("b.feature").alias("feature"), F.col("b.value").alias("value"))


# -- tree ensembles -------------------------------------------------------------

def tree_tables(clf, spark) -> tuple[list, list, str]:
    """Node arrays of a fitted forest / boosted-tree classifier, plus per-tree weights.

    Read from the model's native saved form (``data`` holds one row per node);
    the size is the model's, independent of the data. Forest: leaf value =
    P(class 1) of the leaf, weight 1/T (output = probability). Boosted trees:
    leaf value = the regression output, weight 2 * tree weight (output = log-odds,
    since MLlib's probability is 1 / (1 + exp(-2F))).
    """
    import numpy as np
    from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel

    from ..session import scratch_path

    path = scratch_path(spark, "tree_tables")
    clf.write().overwrite().save(path)
    rows = spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect()
    is_forest = isinstance(clf, RandomForestClassificationModel)
    if not is_forest and not isinstance(clf, GBTClassificationModel):
        raise TypeError(f"not a tree ensemble: {type(clf).__name__}")
    by_tree: dict = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        nodes = by_tree[tid]
        n = max(x["id"] for x in nodes) + 1
        t = {k: np.zeros(n) for k in ("threshold", "value", "cover")}
        t["left"] = np.full(n, -1, dtype=int)
        t["right"] = np.full(n, -1, dtype=int)
        t["feature"] = np.zeros(n, dtype=int)
        for x in nodes:
            i, stats = x["id"], list(x["impurityStats"])
            t["left"][i], t["right"][i] = x["leftChild"], x["rightChild"]
            if x["leftChild"] >= 0:
                t["feature"][i] = x["split"]["featureIndex"]
                t["threshold"][i] = x["split"]["leftCategoriesOrThreshold"][0]
            if is_forest:
                total = sum(stats)
                t["cover"][i] = total
                t["value"][i] = stats[1] / total if total and len(stats) > 1 else 0.0
            else:
                t["cover"][i] = stats[0]
                t["value"][i] = x["prediction"]
        trees.append(t)
    if is_forest:
        weights = [1.0 / len(trees)] * len(trees)
        kind = "probability"
    else:
        weights = [2.0 * w for w in clf.treeWeights]
        kind = "log_odds"
    return trees, weights, kind


def tree_attributions(model, df: DataFrame, features=cfg.MODEL_FEATURES, key: str = cfg.ID_COLUMN,
                      num_partitions: int | None = None) -> DataFrame:
    """H1 (trees): TreeSHAP of a fitted ``Pipeline(assembler, scaler, forest|boosted)`` for every row.

    The scaled feature vectors are produced by the pipeline's own stages; the
    vectorised TreeSHAP runs per Arrow batch in ``mapInPandas``; the node arrays
    (model-sized) are a broadcast variable. Same output shape as
    ``linear_attributions``.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from .treeshap import ensemble_shap

    spark = df.sparkSession
    trees, weights, _ = tree_tables(model.stages[-1], spark)
    # model-sized node arrays: shipped once per executor, not once per task
    shared = spark.sparkContext.broadcast((trees, weights))
    prep = PipelineModel(stages=model.stages[:-1]).transform(df).select(
        F.col(key), vector_to_array("features").alias("_x"))
    # TreeSHAP is CPU-bound per row: spread the rows over the declared parallelism
    prep = prep.repartition(num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key_type = prep.schema[key].dataType.simpleString()
    names = list(features)

    def batches(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf["_x"].to_numpy()).astype(float)
            t, w = shared.value
            phi, base = ensemble_shap(t, w, X)
            out = pd.DataFrame(phi, columns=[f"_phi{i}" for i in range(len(names))])
            out.insert(0, key, pdf[key].to_numpy())
            out["base_value"] = base
            yield out

    schema = f"`{key}` {key_type}, " + ", ".join(f"_phi{i} double" for i in range(len(names))) + \
        ", base_value double"
    wide = prep.mapInPandas(batches, schema)
    return wide.select(key, F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_phi{i}").alias("value"))
                                      for i, f in enumerate(names)]).alias("attributions"), "base_value")
