import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskspark.operators import explain as H
from riskspark.operators import models as D
from riskspark.plans import common
from riskspark.session import scratch_path
from riskspark.streaming import batch_writer, run_stream, run_stream_to_tables, scoring_transform
from tests.conftest import SF_SMALL, STRONG, STUDENT_COLS, WEAK, student_row

SMALL = D.TrainParams(rf_trees=5, gbt_iter=5, lr_max_iter=50)


@pytest.fixture(scope="module")
def trained(spark):
    return D.train_and_select(common.featured(spark, SF_SMALL), SMALL)


def test_training_results(trained):
    rows = trained.metrics.orderBy("model_order").collect()
    assert [r.model for r in rows] == ["Logistic Regression", "Random Forest", "Gradient Boosting"]
    assert sum(r.is_best for r in rows) == 1
    for r in rows:
        for m in ("accuracy", "precision", "recall", "f1", "auc", "cv_f1_mean"):
            assert 0.0 <= r[m] <= 1.0
    best = max(rows, key=lambda r: (r.cv_f1_mean, -r.model_order))
    assert best.is_best


def test_a_fold_is_assembled_and_scaled_once(spark, monkeypatch):
    """All models of a fold learn from the same prepared rows, and are what their pipelines give when fitted alone."""
    fits, real = [], D.StandardScaler._fit
    monkeypatch.setattr(D.StandardScaler, "_fit", lambda self, df: fits.append(1) or real(self, df))
    rows = [(f"s{i}", float(i % 7), float(i * 37 % 11), float(i % 3 > 0), i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "id string, a double, b double, y double, fold int")
    p = D.TrainParams(features=["a", "b"], label="y", key="id", folds=2, rf_trees=2, rf_depth=2, gbt_iter=2, gbt_depth=2, lr_max_iter=5)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    models, cv = D.cross_validate(train, p)
    assert len(fits) == 3 and set(cv) == set(p.models)  # two folds and the refit
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
    for name, model in models.items():
        alone = D.build_pipeline(name, p, len(rows)).fit(train)
        got, want = ([r.probability.toArray().tolist() for r in m.transform(train).orderBy("id").collect()] for m in (model, alone))
        assert got == want


def test_split_is_stratified_and_folds_cover(trained):
    both = trained.train.unionByName(trained.test)
    n = both.count()
    assert trained.test.count() == pytest.approx(0.2 * n, abs=2)
    assert {r.fold for r in trained.train.select("fold").distinct().collect()} == set(range(5))


def test_batch_scoring_keeps_rows_and_probabilities(spark, trained):
    raw = common.students(spark, SF_SMALL)
    out = D.batch_score(trained.models[trained.best_name], raw)
    assert out.count() == raw.count()
    assert set(raw.columns) < set(out.columns)
    for r in out.select("pass_probability", "fail_probability").collect():
        assert abs(r.pass_probability + r.fail_probability - 1.0) <= 1e-4


def test_weak_student_riskier_than_strong(spark, trained):
    df = spark.createDataFrame([student_row("W", **WEAK), student_row("S", **STRONG)], STUDENT_COLS)
    lr = trained.models["Logistic Regression"]
    out = {r.student_id: r for r in scoring_transform(df, lr).collect()}
    assert out["W"].risk_score > out["S"].risk_score
    assert out["W"].risk_level == "High Risk"


def test_linear_attributions_local_accuracy(spark, trained):
    lr = trained.models["Logistic Regression"]
    data = trained.test
    attr = H.model_linear_attributions(lr, data, trained.train)
    total = attr.select("student_id", (F.col("base_value") + F.aggregate(
        "attributions", F.lit(0.0), lambda a, s: a + s["value"])).alias("margin"))
    raw = lr.transform(data).select("student_id", vector_to_array("rawPrediction")[1].alias("m"))
    for r in total.join(raw, "student_id").collect():
        assert r.margin == pytest.approx(r.m, abs=1e-6)


def test_model_roundtrip(spark, trained):
    paths = D.save_models({"lr": trained.models["Logistic Regression"]}, spark=spark)
    loaded = D.load_model(paths["lr"])
    a = D.scored_frame(loaded, trained.test, "result").collect()
    b = D.scored_frame(trained.models["Logistic Regression"], trained.test, "result").collect()
    assert sorted(a) == sorted(b)


def test_stream_equals_batch(spark):
    src = common.students(spark, SF_SMALL)
    path = scratch_path(spark, "t_stream_in")
    src.repartition(3).write.parquet(path)
    sink = run_stream(spark, path, src.schema).sink
    cols = ["row_ordinal", "attendance_risk", "engagement_score", "overall_academic_score"]
    got = sorted(spark.read.parquet(sink).select(*cols).collect())
    want = sorted(scoring_transform(src).select(*cols).collect())
    assert got == want


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["attendance_risk", "n_students", "avg_overall_score"]
    assert df.count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("model_name", ["Random Forest", "Gradient Boosting"])
def test_tree_attributions_local_accuracy(spark, trained, model_name):
    m = trained.models[model_name]
    attr = H.tree_attributions(m, trained.test)
    total = attr.select("student_id", (F.col("base_value") + F.aggregate(
        "attributions", F.lit(0.0), lambda a, s: a + s["value"])).alias("out"))
    scored = m.transform(trained.test).select(
        "student_id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("f"))
    for r in total.join(scored, "student_id").collect():
        want = r.p if model_name == "Random Forest" else 2 * r.f
        assert r.out == pytest.approx(want, abs=1e-6)


def test_treeshap_matches_brute_force_shapley():
    import itertools
    import math as m

    import numpy as np

    from riskspark.operators.treeshap import tree_shap

    # depth-3 tree on 3 features, feature 0 used twice on one path
    t = {"left": np.array([1, 3, 5, -1, -1, 7, -1, -1, -1]), "right": np.array([2, 4, 6, -1, -1, 8, -1, -1, -1]),
         "feature": np.array([0, 1, 2, 0, 0, 0, 0, 0, 0]), "threshold": np.array([0.5, 0.3, 0.7, 0, 0, 0.2, 0, 0, 0]),
         "value": np.array([0, 0, 0, 1.0, 2.0, 0, 5.0, 3.0, 4.0]),
         "cover": np.array([10.0, 4, 6, 3, 1, 4, 2, 1, 3])}
    t["left"][5], t["feature"][5] = 7, 0

    def cond_exp(x, known):
        def go(node):
            if t["left"][node] < 0:
                return t["value"][node]
            f = t["feature"][node]
            if f in known:
                return go(t["left"][node] if x[f] <= t["threshold"][node] else t["right"][node])
            l, r = t["left"][node], t["right"][node]
            return (t["cover"][l] * go(l) + t["cover"][r] * go(r)) / t["cover"][node]
        return go(0)

    X = np.array([[0.1, 0.9, 0.1], [0.9, 0.1, 0.9], [0.3, 0.2, 0.8], [0.6, 0.5, 0.5]])
    phi = tree_shap(t, X)
    for row, x in enumerate(X):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = 0.0
            for k in range(3):
                for s in itertools.combinations(others, k):
                    wgt = m.factorial(k) * m.factorial(3 - k - 1) / m.factorial(3)
                    want += wgt * (cond_exp(x, set(s) | {i}) - cond_exp(x, set(s)))
            assert phi[row, i] == pytest.approx(want, abs=1e-12)


def test_treeshap_random_trees_match_brute_force():
    import itertools
    import math as m

    import numpy as np

    from riskspark.operators.treeshap import ensemble_shap, expected_value, predict, tree_shap

    rng = np.random.default_rng(5)

    def random_tree(depth, n_feat):
        left, right, feat, thr, val, cov = [], [], [], [], [], []

        def node(d, c):
            i = len(left)
            for a in (left, right, feat, thr, val, cov):
                a.append(0)
            cov[i] = c
            if d == depth or rng.uniform() < 0.2:
                left[i], right[i], val[i] = -1, -1, float(rng.normal())
                return i
            feat[i], thr[i] = int(rng.integers(0, n_feat)), float(rng.uniform())   # repeats likely
            share = float(rng.uniform(0.2, 0.8))
            left[i] = node(d + 1, c * share)
            right[i] = node(d + 1, c * (1 - share))
            return i

        node(0, 100.0)
        return {"left": np.array(left), "right": np.array(right), "feature": np.array(feat),
                "threshold": np.array(thr), "value": np.array(val), "cover": np.array(cov)}

    def cond_exp(t, x, known):
        def go(i):
            if t["left"][i] < 0:
                return t["value"][i]
            f = t["feature"][i]
            if f in known:
                return go(t["left"][i] if x[f] <= t["threshold"][i] else t["right"][i])
            a, b = t["left"][i], t["right"][i]
            return (t["cover"][a] * go(a) + t["cover"][b] * go(b)) / t["cover"][i]
        return go(0)

    F_ = 4
    X = rng.uniform(size=(6, F_))
    for _ in range(6):
        t = random_tree(5, F_)
        phi = tree_shap(t, X)
        for row, x in enumerate(X):
            for i in range(F_):
                others = [j for j in range(F_) if j != i]
                want = 0.0
                for k in range(F_):
                    for s in itertools.combinations(others, k):
                        wgt = m.factorial(k) * m.factorial(F_ - k - 1) / m.factorial(F_)
                        want += wgt * (cond_exp(t, x, set(s) | {i}) - cond_exp(t, x, set(s)))
                assert phi[row, i] == pytest.approx(want, abs=1e-10)
        # local accuracy: base + sum = output
        phi_e, base = ensemble_shap([t], [1.0], X)
        assert np.allclose(base + phi_e.sum(axis=1), predict([t], [1.0], X), atol=1e-10)
        assert base == pytest.approx(expected_value(t))


def test_record_without_id_or_name_reports_unknown(spark, trained):
    rec = spark.createDataFrame([student_row("X", **WEAK)], STUDENT_COLS).drop("student_id", "name")
    out = scoring_transform(rec, trained.models[trained.best_name]).first()
    assert (out.student_id, out.name) == ("UNKNOWN", "Unknown")
    kept = spark.createDataFrame([student_row(None, **WEAK)], STUDENT_COLS)
    assert scoring_transform(kept).first().student_id is None   # a NULL id is not replaced


def test_training_frame_is_rebalanced_not_left_in_class_partitions(spark):
    # A frame that is large relative to AQE's advisory size must come out in several
    # partitions (its ranks come from windows over 2 classes, which leave 1-2 partitions).
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "8k")
        spark.conf.set(keys[1], "4k")
        data = D.prepare_training(common.featured(spark, SF_SMALL), D.TrainParams())
        sizes = [r["count"] for r in data.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > 2 and sum(sizes) == data.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_registered_queries_use_the_reference_sizes():
    from riskspark.plans import ml_queries
    p = ml_queries.QUERY_PARAMS
    assert (p.rf_trees, p.gbt_iter, p.lr_max_iter) == (200, 200, 1000)


def test_stream_to_table_once_and_stopped(spark):
    """A batch that is run again adds no row; a running query is in the caller's hands."""
    from riskspark.operators import tables
    from riskspark.plans.stream_queries import AttendanceRule

    src = spark.createDataFrame([(i, *student_row(f"S{i}", att=float(i))) for i in range(30)], "row_ordinal long, " + STUDENT_COLS)
    path, log = scratch_path(spark, "t_stream_in"), scratch_path(spark, "t_stream_log")
    src.filter("row_ordinal < 20").write.parquet(path)
    parent = src.filter("row_ordinal <> 3").select("student_id")
    q = run_stream_to_tables(spark, path, src.schema, log, AttendanceRule(), parent, available_now=False, processing_time="1 second")
    q.query.processAllAvailable()
    src.filter("row_ordinal >= 20").write.mode("append").parquet(path)
    q.query.processAllAvailable()
    assert q.query.isActive
    q.query.stop()
    assert not q.query.isActive and q.sink == log
    out = tables.read(spark, log)
    assert out.count() == 29 and [r.id for r in out.orderBy("id").collect()] == list(range(1, 30))
    assert [r.student_id for r in tables.rejects(spark, log).collect()] == ["S3"]
    write = batch_writer(log, AttendanceRule(), parent)
    write(src, 0)  # a number that is committed
    assert tables.read(spark, log).count() == 29
    write(src, 99)
    assert tables.read(spark, log).count() == 58


def test_sampled_attributions_match_brute_force(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(9)
    names = [f"f{i}" for i in range(5)]
    x, back = rng.normal(0, 1, (12, 5)), rng.normal(0, 1, (20, 5))

    def fn(z):  # interactions and a curve
        return 1 / (1 + np.exp(-(1.5 * z[:, 0] - z[:, 1] * z[:, 2] + 0.7 * z[:, 3] ** 2 - z[:, 4])))

    def worth(row, known):
        z = back.copy()
        z[:, list(known)] = row[list(known)]
        return fn(z).mean()

    exact = np.zeros((12, 5))
    for i, row in enumerate(x):
        for j in range(5):
            others = [k for k in range(5) if k != j]
            for size in range(5):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                    exact[i, j] += share * (worth(row, (*s, j)) - worth(row, s))
    df = spark.createDataFrame([(f"S{i}", *map(float, r)) for i, r in enumerate(x)] + [("gap", None, 1.0, 1.0, 1.0, 1.0)], "student_id string, " + ", ".join(f"{n} double" for n in names))
    got = {r.student_id: r for r in H.sampled_attributions(fn, df.repartition(3), back, names, pairs=40).collect()}
    assert got.pop("gap").attributions == [] and len(got) == 12
    for i in range(12):
        value = np.array([a.value for a in got[f"S{i}"].attributions])
        error = np.array([a.error for a in got[f"S{i}"].attributions])
        assert [a.feature for a in got[f"S{i}"].attributions] == names
        assert (np.abs(value - exact[i]) <= 5 * error + 1e-3).all() and error.max() < 0.02
        assert value.sum() + got[f"S{i}"].base_value == pytest.approx(fn(x[i:i + 1])[0], abs=1e-9)


def test_sampled_attributions_of_a_model(spark, trained):
    fn = H.logistic_probability(trained.models[D.LR])
    back = H.background_table(trained.train, D.TrainParams().features, rows=20)
    got = H.sampled_attributions(fn, trained.test, back, D.TrainParams().features, pairs=4)
    total = got.select("student_id", (F.col("base_value") + F.aggregate("attributions", F.lit(0.0), lambda a, s: a + s["value"])).alias("out"))
    scored = trained.models[D.LR].transform(trained.test).select("student_id", vector_to_array("probability")[1].alias("p"))
    rows = total.join(scored, "student_id").collect()
    assert rows and all(r.out == pytest.approx(r.p, abs=1e-6) for r in rows)


def test_one_saved_pipeline_scores_raw_rows(spark, trained):
    from pyspark.ml import PipelineModel
    from riskspark.operators import stages

    raw = common.students(spark, SF_SMALL)
    for name, model in trained.models.items():
        path = scratch_path(spark, "t_pipeline")
        stages.scoring_pipeline(model).save(path)
        got = PipelineModel.load(path).transform(raw)
        want = D.batch_score(model, raw)
        assert got.columns == want.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    strict = stages.scoring_pipeline(trained.models[D.LR])
    strict.stages[-1].set(strict.stages[-1].high, 0.0)
    assert {r.risk_level for r in strict.transform(raw).select("risk_level").distinct().collect()} == {"High Risk"}


def test_saved_cleaner_equals_the_fit_mode(spark):
    from riskspark.operators import clean, stages

    raw = common.students(spark, SF_SMALL)
    first = clean.dedup_first(raw)
    model = stages.StudentCleaner().fit(first)
    path = scratch_path(spark, "t_cleaner")
    model.save(path)
    got = stages.StudentCleanerModel.load(path).transform(first)
    want, _ = clean.clean_fit(raw)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    unseen = got.limit(0).sparkSession.createDataFrame([(1, *student_row("S1", dept="Nowhere", gender=None, att=None))], "row_ordinal long, " + STUDENT_COLS)
    r = model.transform(unseen).first()
    assert r.department == -1 and r.gender >= 0 and r.attendance_percentage is not None


def test_treeshap_pattern_tables_match_subset_sums():
    """Every pattern's values against the sum over subsets, with a share of 0 too; many rows give what single ones do."""
    import itertools
    import math as m

    import numpy as np

    from riskspark.operators import treeshap

    rng = np.random.default_rng(8)
    for d in (1, 2, 5):
        z, value = rng.uniform(size=(2, d)), rng.normal(size=2)
        z[1, 0] = 0.0
        table = treeshap.pattern_tables(z, value)
        for leaf, code, i in itertools.product(range(2), range(2 ** d), range(d)):
            o = [code >> k & 1 for k in range(d)]
            others = [k for k in range(d) if k != i]
            want = sum(m.factorial(len(s)) * m.factorial(d - len(s) - 1) / m.factorial(d) * np.prod([o[k] if k in s else z[leaf, k] for k in others])
                       for n in range(d) for s in itertools.combinations(others, n)) * (o[i] - z[leaf, i]) * value[leaf]
            assert table[leaf, code, i] == pytest.approx(want, abs=1e-12)
    t = {"left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]), "feature": np.array([0, 0, 1, 0, 0]),
         "threshold": np.array([0.5, 0, 0.2, 0, 0]), "value": np.array([0, 1.0, 0, 2.0, 5.0]), "cover": np.array([9.0, 4, 5, 2, 3])}
    X = rng.uniform(size=(treeshap.ROWS + 3, 2))
    assert np.array_equal(treeshap.tree_shap(t, X)[-5:], np.concatenate([treeshap.tree_shap(t, X[k:k + 1]) for k in range(len(X) - 5, len(X))]))


def test_long_fits_are_not_left_for_the_end():
    from riskspark.operators.models import GBT, LR, RF, TrainParams, fit_order

    order = fit_order(TrainParams())
    assert sorted(order, key=str) == sorted([(m, k) for m in (LR, RF, GBT) for k in (None, 0, 1, 2, 3, 4)], key=str)
    assert {m for m, _ in order[12:]} == {LR} and {m for m, _ in order[:6]} == {GBT, RF}
    assert sorted(fit_order(TrainParams(models=(LR, RF), folds=2)), key=str) == sorted([(m, k) for m in (LR, RF) for k in (None, 0, 1)], key=str)
