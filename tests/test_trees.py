import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import trees as T
from riskspark.operators.explain import tree_tables


def labelled(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), x[:, 3] > 1
    y = x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.5 * rng.normal(size=n) > 0
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(b)) for i, (r, b) in enumerate(zip(x, y))], "id int, x array<double>, y double")
    return rows.select("id", array_to_vector("x").alias("features"), "y").coalesce(1).persist()


@pytest.fixture(scope="module")
def rows(spark):
    return labelled(spark, 1500, 1)


def passes(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])


def test_boosted_trees_are_mllibs(spark, rows):
    kind = dict(labelCol="y", maxIter=8, maxDepth=4, seed=42)
    want, got = GBTClassifier(**kind).fit(rows), T.BoostedLearner(**kind).fit(rows)
    assert passes(got, rows) == pytest.approx(passes(want, rows), abs=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-6)
    # MLlib also splits a node whose residuals are equal but for rounding
    assert all(0 <= w.numNodes - g.numNodes <= 4 for g, w in zip(got.trees, want.trees))
    assert got.treeWeights == want.treeWeights and got.getMaxDepth() == 4
    assert [t["cover"][0] for t in tree_tables(got, spark)[0]] == [1500] * 8


def test_boosted_fits_share_their_jobs(spark, rows):
    """Three fits take as many growing jobs as one, and are what each gives alone."""
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    learner = T.BoostedLearner(labelCol="y", maxIter=3, maxDepth=3, seed=42)
    parts = [rows.filter(F.col("id") % 3 != k) for k in range(3)]
    jobs, grown = [], []
    for name, frames in (("one", parts[:1]), ("three", parts)):
        sc.setJobGroup(f"boosted {name}", name)
        grown.append(T.grow_boosted(learner, frames)[0])
        jobs.append(len(tracker.getJobIdsForGroup(f"boosted {name}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] >= 9
    for a, b in zip(grown[0][0], grown[1][0]):
        assert all(np.array_equal(a[k], b[k]) for k in a)
    assert not any(np.array_equal(grown[1][0][1]["prediction"], grown[1][k][1]["prediction"]) for k in (1, 2))


def test_blocks_add_up(spark, rows, monkeypatch):
    """Rows in many blocks, added up by fit before the driver, with cut lineage: the same trees."""
    learner = T.BoostedLearner(labelCol="y", maxIter=4, maxDepth=3, seed=42)
    want = passes(learner.fit(rows), rows)
    for name, value in (("BOOSTED_ROWS", 100), ("DIRECT", 1), ("CUT_EVERY", 2)):
        monkeypatch.setattr(T, name, value)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert passes(learner.fit(rows), rows) == pytest.approx(want, abs=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held


def test_forest_does_mllibs_work(spark, rows):
    kind = dict(labelCol="y", numTrees=40, maxDepth=7, maxBins=128, minInstancesPerNode=2, seed=42)
    want, got = RandomForestClassifier(**kind).fit(rows), T.ForestLearner(**kind).fit(rows)
    auc = BinaryClassificationEvaluator(labelCol="y")
    fresh = labelled(spark, 1500, 2)
    assert auc.evaluate(got.transform(fresh)) == pytest.approx(auc.evaluate(want.transform(fresh)), abs=0.02)
    assert np.corrcoef(passes(got, rows), passes(want, rows))[0, 1] > 0.97
    assert got.getNumTrees == 40 and got.totalNumNodes == pytest.approx(want.totalNumNodes, rel=0.1)
    assert np.abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 0.1
    for t in tree_tables(got, spark)[0]:              # bootstrap rows, all in the leaves
        split = t["left"] >= 0
        assert np.array_equal(t["cover"][split], t["cover"][t["left"][split]] + t["cover"][t["right"][split]])
        assert t["cover"].min() >= 2 and 1300 < t["cover"][0] < 1700
    again = T.ForestLearner(**kind).fit_all([fresh, rows.repartition(5)])[1]
    assert np.array_equal(passes(again, rows), passes(got, rows))


def test_forest_splits_match_a_plain_search():
    rng = np.random.default_rng(3)
    s, m, n_bins, least = 40, 3, 6, 2
    subsets = np.argsort(rng.random((s, 5)), axis=1)[:, :m]
    n_splits = np.array([5, 5, 3, 1, 0])
    h = np.zeros((2, s, m, n_bins))
    for i in range(s):                                # every feature's bins hold the node's rows
        for c in (0, 1):
            n = rng.integers(1, 9)
            for j in range(m):
                np.add.at(h[c, i, j], rng.integers(0, n_splits[subsets[i, j]] + 1, n), 1)
    flat = h.reshape(-1)
    at = np.flatnonzero(flat)
    parts = [(at, np.floor(flat[at] / 2)), (None, np.ceil(flat / 2))]
    feature, cut, gain, total, left = T.forest_splits(parts, subsets, n_splits, n_bins, least)

    def gini(x):
        return 1 - ((x / x.sum()) ** 2).sum()

    for i in range(s):
        whole, best = h[:, i, 0].sum(axis=1), 0.0
        for j in range(m):
            for b in range(n_splits[subsets[i, j]]):
                a = h[:, i, j, :b + 1].sum(axis=1)
                if min(a.sum(), (whole - a).sum()) >= least:
                    best = max(best, gini(whole) - a.sum() / whole.sum() * gini(a) - (whole - a).sum() / whole.sum() * gini(whole - a))
        assert np.array_equal(total[i], whole)
        if feature[i] < 0:
            assert best <= 1e-12
        else:
            assert gain[i] == pytest.approx(best, abs=1e-12)
            assert np.array_equal(left[i], h[:, i, list(subsets[i]).index(feature[i]), :cut[i] + 1].sum(axis=1))


def test_bootstrap_weights_are_poisson():
    w = T.poisson_weights(np.random.default_rng(0), 400_000)
    want = np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120])
    assert np.bincount(w)[:6] / len(w) == pytest.approx(want, abs=0.003)


def test_no_rows_and_one_class(spark, rows):
    with pytest.raises(ValueError):
        T.ForestLearner(labelCol="y", numTrees=2).fit(rows.limit(0))
    one = rows.limit(50).withColumn("y", F.lit(1.0))
    assert passes(T.ForestLearner(labelCol="y", numTrees=2, seed=1).fit(one), one).min() == 1.0
    assert passes(T.BoostedLearner(labelCol="y", maxIter=2, seed=1).fit(one), one).min() > 0.5
