"""Forests and boosted trees grown together on blocks of binned rows (survey 2.D).

The method, parameters and saved form are MLlib's: levels of histograms over at most ``maxBins`` bins a feature, forests with
Poisson bootstrap weights and a random subset of features a node, boosting with the log loss's gradient.
What differs is how the rows are held: a partition is a few blocks (one byte a feature and row), a histogram of a block is
counted by NumPy, and several fits (the folds and the refit) share each Spark job. So boosting takes one job a round and
level for all fits instead of one each, and a forest one job a level for all its trees and fits.

Spark moves histograms and split nodes only. Forests: a task counts its blocks' rows per tree, the counts meet by (fit, tree),
and the best splits are found there. Boosted trees: the counts of a level (at most 2 ** 5 nodes) are added up and split on the driver.
The fitted models are MLlib's own, loaded from their native form.

Split candidates follow MLlib's rule on a sample of the size that MLlib takes; up to that size they are MLlib's. The random draws of a forest are
other ones than MLlib's (which change with the partitions of the rows).
"""

from __future__ import annotations

import functools
import gc
import json
import math
import pickle
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows of a block, at least (forests, boosted trees) and at most
FOREST_ROWS, BOOSTED_ROWS, MOST_ROWS = 1 << 14, 1 << 16, 1 << 18
#: partitions whose histograms go straight to the driver; with more they are added up by fit before
DIRECT = 64
#: nodes of a forest's tree whose splits are compared at once
NODES = 32
#: rounds between two cuts of the lineage
CUT_EVERY = 25
#: impurity below which a node is pure
EPSILON = 2.2e-16


@functools.cache
def settle() -> None:
    """Takes what a Python worker has loaded out of the collection that follows each of its many short tasks (once per worker)."""
    gc.freeze()


# -- blocks -------------------------------------------------------------------

def row_blocks(df: DataFrame, features: str, label: str, rows: int):
    """RDD of (partition, number, values (features x rows), labels), a block's rows at most about ``rows``.

    A block's rows are sorted by value, so a block that is computed again has the same rows in the same places."""
    def pack(batches):
        held, n = [], 0

        def out():
            x = np.concatenate([h[0] for h in held], axis=1)
            y = np.concatenate([h[1] for h in held])
            order = np.lexsort((y, *x))
            return pickle.dumps((np.ascontiguousarray(x[:, order]), y[order]), protocol=5)

        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            held.append((lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T, batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= rows:
                yield pa.RecordBatch.from_pydict({"block": pa.array([out()], pa.binary())})
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array([out()], pa.binary())})

    flat = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return flat.mapInArrow(pack, "block binary").rdd.mapPartitionsWithIndex(
        lambda part, found: ((part, i, *pickle.loads(bytes(r.block))) for i, r in enumerate(found)))


def split_points(values: np.ndarray, max_bins: int) -> np.ndarray:
    """MLlib's split candidates of a feature: midpoints of neighbouring values, at equal counts where there are many."""
    v, c = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) - 1 <= max_bins - 1:
        return (v[:-1] + v[1:]) / 2
    stride, found, count = c.sum() / max_bins, [], int(c[0])
    target = stride
    for i, more in enumerate(c[1:].tolist(), 1):
        before, count = count, count + more
        if abs(before - target) < abs(count - target):
            found.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(found)


def poisson_weights(rng: np.random.Generator, n: int) -> np.ndarray:
    """Bootstrap weights of ``n`` rows: Poisson with mean 1, by its inverse distribution."""
    u, out, p, below = rng.random(n), np.zeros(n, np.uint8), math.exp(-1.0), 0.0
    for k in range(1, 19):                            # P(more than 18) is below a double's last place
        below += p
        p /= k
        out += u >= below
    return out


def binned(frames: list, estimator, least: int):
    """(persisted RDD of (fit, name, bins, labels), candidates by fit and feature) of the frames."""
    sc = frames[0].sparkSession.sparkContext
    bins_at_most, seed = estimator.getMaxBins(), estimator.getSeed()
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    with ThreadPoolExecutor(len(frames)) as pool:     # small jobs: they wait for each other's ends otherwise
        counts = list(pool.map(lambda f: f.count(), frames))
        if not all(counts):
            raise ValueError("no rows to learn from")
        size = min(max(least, sum(counts) // (2 * sc.defaultParallelism)), MOST_ROWS)

        def candidates(frame, n):
            blocks = row_blocks(frame.repartition(math.ceil(n / size)), features, label, MOST_ROWS)
            share = min(1.0, max(bins_at_most ** 2, 10_000) / n)

            def some(block):
                rng = np.random.default_rng([seed & 0xFFFFFFFF, block[0], block[1], 1])
                return block[2] if share == 1.0 else block[2][:, rng.random(block[2].shape[1]) < share]

            sample = np.concatenate(blocks.map(some).collect(), axis=1)
            return blocks, [split_points(v, min(bins_at_most, n)) for v in sample]

        raw, cuts = zip(*pool.map(candidates, frames, counts))
    kind = np.uint8 if bins_at_most <= 256 else np.uint16

    def into(fit, found):
        def one(block):
            bins = np.stack([np.searchsorted(t, v, side="left") for t, v in zip(found, block[2])]).astype(kind)
            return fit, (block[0], block[1]), bins, block[3].astype(np.int8)
        return one

    rdd = sc.union([b.map(into(i, t)) for i, (b, t) in enumerate(zip(raw, cuts))]).persist(StorageLevel.MEMORY_AND_DISK)
    return rdd, cuts


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, rows: np.ndarray):
    """(places in ``rows`` that are still in a split node's child, their nodes) after ``levels`` steps down a tree.

    Nodes are numbered like a heap's; ``feature`` is -1 where a node is not split."""
    flat, n = bins.reshape(-1), bins.shape[1]
    node, at = np.zeros(len(rows), np.int64), None
    for _ in range(levels):
        f = np.take(feature, node)
        if f.min(initial=0) < 0:
            keep = np.flatnonzero(f >= 0)
            node, f, rows = node[keep], f[keep], rows[keep]
            at = keep if at is None else at[keep]
        node = 2 * node + 1 + (np.take(flat, f * n + rows) > np.take(cut, node))
    return at, node


# -- forests --------------------------------------------------------------------

def gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / n[..., None]
        return np.where(n > 0, 1.0 - (p * p).sum(axis=-1), 0.0)


def forest_counts(block, level: int, trees: dict, n_bins: int, seed: int):
    """((fit, tree), counts of the cells (node, feature of its subset, bin, class)) of a block's bootstrap rows."""
    fit, name, bins, y = block
    n, flat = bins.shape[1], bins.reshape(-1)
    for t, small in trees[fit].items():
        feature, cut, slots, subsets = (a.astype(np.int64) for a in small)
        w = poisson_weights(np.random.default_rng([seed & 0xFFFFFFFF, t, *name, 2]), n)
        rows = np.flatnonzero(w)
        at, node = walk(bins, feature, cut, level, rows)
        rows = rows if at is None else rows[at]
        slot = slots[node - ((1 << level) - 1)]
        if (slot < 0).any():
            keep = np.flatnonzero(slot >= 0)
            slot, rows = slot[keep], rows[keep]
        if not len(rows):
            continue
        m = subsets.shape[1]
        cells = np.empty((m, len(rows)), np.int64)
        base = slot * (m * n_bins) + y[rows].astype(np.int64) * (len(subsets) * m * n_bins)
        for j in range(m):
            cells[j] = base + j * n_bins + flat[np.take(subsets[:, j] * n, slot) + rows]
        counts = np.bincount(cells.reshape(-1), weights=np.tile(w[rows].astype(float), m), minlength=2 * len(subsets) * m * n_bins)
        filled = np.flatnonzero(counts)
        kind = np.min_scalar_type(int(counts.max()))
        if 2 * len(filled) < len(counts):
            yield (fit, t), (filled.astype(np.uint32), counts[filled].astype(kind))
        else:
            yield (fit, t), (None, counts.astype(kind))


def forest_splits(parts, subsets: np.ndarray, n_splits: np.ndarray, n_bins: int, least: int):
    """(feature or -1, cut, gain, counts, counts of the left child) by node from the blocks' cells."""
    s, m = subsets.shape
    h = np.zeros(2 * s * m * n_bins)
    for at, counts in parts:
        if at is None:
            h += counts
        else:
            h[at] += counts
    h = h.reshape(2, s, m, n_bins)
    there = np.arange(n_bins - 1)[None, None] < n_splits[subsets][:, :, None]
    found = []
    for a in range(0, s, NODES):                      # few nodes at a time: their arrays stay in the cache
        fail, ok = np.cumsum(h[:, a:a + NODES], axis=3)[..., :-1]
        total = h[:, a:a + NODES, 0].sum(axis=2)
        n, n_left = total.sum(axis=0)[:, None, None], fail + ok
        n_right = n - n_left
        with np.errstate(divide="ignore", invalid="ignore"):   # the purest children, up to what all splits of a node share
            score = (fail * fail + ok * ok) / n_left + ((total[0][:, None, None] - fail) ** 2 + (total[1][:, None, None] - ok) ** 2) / n_right
        score = np.where((n_left >= least) & (n_right >= least) & there[a:a + NODES], score, -1.0).reshape(len(n), -1)
        best, at = score.argmax(axis=1), np.arange(len(n))
        left = np.stack([x.reshape(len(n), -1)[at, best] for x in (fail, ok)], axis=1)
        found.append((best, score[at, best] < 0, total.T, left))
    best, none, total, left = (np.concatenate(x) for x in zip(*found))
    right, j = total - left, best // (n_bins - 1)
    n = total.sum(axis=1)
    gain = gini(total) - left.sum(axis=1) / n * gini(left) - right.sum(axis=1) / n * gini(right)
    feature = np.where(~none & (gain > 0), subsets[np.arange(s), j], -1)
    return feature, best % (n_bins - 1), gain, total, left


def grow_forests(estimator, frames: list) -> tuple[list, int]:
    """(per frame the trees: nodes in heap order, number of features)."""
    spark = frames[0].sparkSession
    rdd, cuts = binned(frames, estimator, FOREST_ROWS)
    depth, n_trees, seed, least = estimator.getMaxDepth(), estimator.getNumTrees(), estimator.getSeed(), estimator.getMinInstancesPerNode()
    n_bins = 1 + max(1, *(len(t) for c in cuts for t in c))
    n_features = len(cuts[0])
    m = max(1, math.ceil(math.sqrt(n_features))) if n_trees > 1 else n_features
    nodes, n_fits = (1 << depth + 1) - 1, len(frames)
    feature = np.full((n_fits, n_trees, nodes), -1, np.int64)
    cut = np.zeros((n_fits, n_trees, nodes), np.int64)
    gain = np.full((n_fits, n_trees, nodes), -1.0)
    counts = np.zeros((n_fits, n_trees, nodes, 2))
    n_splits = [np.array([len(t) for t in c]) for c in cuts]
    todo = np.zeros((n_fits, n_trees, nodes), bool)
    todo[:, :, 0] = True
    try:
        for level in range(max(depth, 1)):
            first, last = (1 << level) - 1, (1 << level + 1) - 1
            trees: dict = {i: {} for i in range(n_fits)}
            for i, t in np.argwhere(todo[:, :, first:last].any(axis=2)).tolist():
                mine = todo[i, t, first:last]
                slots = np.where(mine, np.cumsum(mine) - 1, -1)
                rng = np.random.default_rng([seed & 0xFFFFFFFF, t, level, 3])
                some = np.argsort(rng.random((int(mine.sum()), n_features)), axis=1)[:, :m]
                trees[i][t] = tuple(a.astype(np.int16) for a in (feature[i, t, :last], cut[i, t, :last], slots, some))
            if not any(trees.values()):
                break
            shared = spark.sparkContext.broadcast((trees, n_splits))

            def count(block, level=level, shared=shared):
                return forest_counts(block, level, shared.value[0], n_bins, seed)

            def best(item, shared=shared):
                (i, t), parts = item
                return i, t, forest_splits(parts, shared.value[0][i][t][3], shared.value[1][i], n_bins, least)

            tasks = min(max(spark.sparkContext.defaultParallelism, rdd.getNumPartitions()), n_fits * n_trees)
            for i, t, (f, c, g, total, left) in rdd.flatMap(count).groupByKey(tasks).map(best).collect():
                at = np.flatnonzero(todo[i, t, first:last]) + first
                counts[i, t, at] = total
                if depth == 0:
                    continue
                ok = f >= 0
                at, left, right = at[ok], left[ok], total[ok] - left[ok]
                feature[i, t, at], cut[i, t, at], gain[i, t, at] = f[ok], c[ok], g[ok]
                for child, has in ((2 * at + 1, left), (2 * at + 2, right)):
                    counts[i, t, child] = has
                    if level + 1 < depth:             # a node that is too small for two children stays a leaf
                        todo[i, t, child] = (gini(has) >= EPSILON) & (has.sum(axis=1) >= 2 * least)
            shared.unpersist()
    finally:
        rdd.unpersist()
    out = []
    for i in range(n_fits):
        table = np.zeros((n_features, max(1, *(len(t) for t in cuts[i]))))
        for f, t in enumerate(cuts[i]):
            table[f, :len(t)] = t
        for level in range(depth - 1, -1, -1):        # leaves of one parent that predict the same are one, as in MLlib
            at = np.arange((1 << level) - 1, (1 << level + 1) - 1)
            says = counts[i, :, :, 1] > counts[i, :, :, 0]
            leaf = feature[i] < 0
            same = (feature[i, :, at].T >= 0) & leaf[:, 2 * at + 1] & leaf[:, 2 * at + 2] & (says[:, 2 * at + 1] == says[:, 2 * at + 2])
            feature[i][:, at] = np.where(same, -1, feature[i][:, at])
        out.append([{"feature": feature[i, t], "threshold": table[np.maximum(feature[i, t], 0), cut[i, t]], "gain": gain[i, t],
                     "impurity": gini(counts[i, t]), "stats": counts[i, t], "count": counts[i, t].sum(axis=1),
                     "prediction": (counts[i, t, :, 1] > counts[i, t, :, 0]).astype(float)} for t in range(n_trees)])
    return out, n_features


# -- boosted trees ----------------------------------------------------------------

def residual(y: np.ndarray, margin) -> np.ndarray:
    """What a round's tree learns: the labels (-1, 1) first, then the negative gradient of the log loss."""
    return y if margin is None else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))


def boosted_counts(block, level: int, tree, n_bins: int):
    """(fit, (counts, sums) of the residuals by (node, feature, bin)) of a block at a level of the round's tree."""
    settle()
    fit, _, bins, y, margin, squares = block
    feature, cut, slots = tree
    n_slots = int(slots.max()) + 1
    r, part = residual(y, margin), bins
    at, node = walk(bins, feature, cut, level, np.arange(bins.shape[1]))
    if at is not None:
        r, part = r[at], bins[:, at]
    slot = slots[node - ((1 << level) - 1)]
    if (slot < 0).any():
        keep = np.flatnonzero(slot >= 0)
        slot, r, part = slot[keep], r[keep], part[:, keep]
    base, size = slot * n_bins, n_slots * n_bins
    out = np.zeros((2, len(bins), size))
    for f, b in enumerate(part):
        cell = base + b
        out[0, f] = np.bincount(cell, minlength=size)
        out[1, f] = np.bincount(cell, weights=r, minlength=size)
    return fit, (out, squares)


def boosted_splits(h: np.ndarray, n_splits: np.ndarray, n_bins: int, least: int):
    """(feature or -1, cut, gain, (n, sum), (n, sum) of the left child) by node; ``h``: (2, features, nodes * bins)."""
    h = h.reshape(2, len(n_splits), -1, n_bins).transpose(0, 2, 1, 3)
    total = h[:, :, 0].sum(axis=2)
    left = np.cumsum(h, axis=3)[..., :-1]
    n, s = total[0][:, None, None], total[1][:, None, None]
    n_left, s_left = left
    n_right, s_right = n - n_left, s - s_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (s_left * s_left / n_left + s_right * s_right / n_right - s * s / n) / n
    there = np.arange(n_bins - 1)[None, None] < n_splits[None, :, None]
    gain = np.where((n_left >= least) & (n_right >= least) & there, gain, -1.0).reshape(len(n), -1)
    best, at = gain.argmax(axis=1), np.arange(len(n))
    gain = gain[at, best]
    f, b = best // (n_bins - 1), best % (n_bins - 1)
    noise = 1e-15 * (total[1] / np.maximum(total[0], 1)) ** 2   # equal residuals differ by rounding alone
    return np.where(gain > noise, f, -1), b, gain, total, left[:, at, f, b]


def advance(block, tree, value: np.ndarray, weight: float):
    """The block with the round's tree added to the margins, and the squares of the residuals by leaf."""
    fit, name, bins, y, margin, _ = block
    feature, cut, depth = tree
    r = residual(y, margin)
    node = np.zeros(bins.shape[1], np.int64)
    rows, left = np.arange(bins.shape[1]), node
    for _ in range(depth):
        f = feature[left]
        keep = np.flatnonzero(f >= 0)
        rows, left, f = rows[keep], left[keep], f[keep]
        left = 2 * left + 1 + (bins[f, rows] > cut[left])
        node[rows] = left
    margin = weight * value[node] + (0.0 if margin is None else margin)
    return fit, name, bins, y, margin, np.bincount(node, weights=r * r, minlength=len(value))


def grow_boosted(estimator, frames: list) -> tuple[list, int]:
    """(per frame the rounds' trees: nodes in heap order, number of features)."""
    sc = frames[0].sparkSession.sparkContext
    state, cuts = binned(frames, estimator, BOOSTED_ROWS)
    binned_rows = state
    depth, rounds, step, least = estimator.getMaxDepth(), estimator.getMaxIter(), estimator.getStepSize(), estimator.getMinInstancesPerNode()
    n_bins = 1 + max(1, *(len(t) for c in cuts for t in c))
    n_fits, n_features, nodes = len(frames), len(cuts[0]), (1 << depth + 1) - 1
    n_splits = [np.array([len(t) for t in c]) for c in cuts]
    direct = state.getNumPartitions() <= DIRECT
    state = state.map(lambda b: (b[0], b[1], b[2], 2.0 * b[3] - 1.0, None, None)).persist(StorageLevel.MEMORY_AND_DISK)
    held, grown = [binned_rows, state], [[] for _ in frames]

    def add(a, b):
        return a[0] + b[0], None if a[1] is None else a[1] + b[1]

    def gathered(rdd) -> dict:
        if not direct:
            return dict(rdd.reduceByKey(add, n_fits).collect())
        found: dict = {}
        for i, got in rdd.collect():
            found[i] = add(found[i], got) if i in found else got
        return found

    try:
        for number in range(rounds):
            trees = [{"feature": np.full(nodes, -1, np.int64), "cut": np.zeros(nodes, np.int64), "gain": np.full(nodes, -1.0),
                      "count": np.zeros(nodes), "sum": np.zeros(nodes)} for _ in frames]
            todo = np.zeros((n_fits, nodes), bool)
            todo[:, 0] = True
            for level in range(max(depth, 1)):
                first, last = (1 << level) - 1, (1 << level + 1) - 1
                now = {}
                for i in np.flatnonzero(todo[:, first:last].any(axis=1)).tolist():
                    mine = todo[i, first:last]
                    now[i] = (trees[i]["feature"][:last], trees[i]["cut"][:last], np.where(mine, np.cumsum(mine) - 1, -1))
                if not now:
                    break
                found = gathered(state.filter(lambda b, now=now: b[0] in now)
                                 .map(lambda b, now=now, level=level: boosted_counts(b, level, now[b[0]], n_bins)))
                if level == 0 and number:             # the state of this round is there: the one before can go
                    for i, (_, squares) in found.items():
                        grown[i][-1]["squares"] = squares
                    while len(held) > 1:
                        held.pop(0).unpersist()
                for i, (h, _) in found.items():
                    tree = trees[i]
                    f, c, g, total, left = boosted_splits(h, n_splits[i], n_bins, least)
                    at = np.flatnonzero(todo[i, first:last]) + first
                    tree["count"][at], tree["sum"][at] = total
                    if depth == 0:
                        continue
                    ok = f >= 0
                    at, left, right = at[ok], left[:, ok], total[:, ok] - left[:, ok]
                    tree["feature"][at], tree["cut"][at], tree["gain"][at] = f[ok], c[ok], g[ok]
                    for child, has in ((2 * at + 1, left), (2 * at + 2, right)):
                        tree["count"][child], tree["sum"][child] = has
                        if level + 1 < depth:
                            todo[i, child] = has[0] >= 2 * least
            last_trees = []
            for i, tree in enumerate(trees):
                tree["prediction"] = tree["sum"] / np.maximum(tree["count"], 1)
                grown[i].append(tree)
                last_trees.append(((tree["feature"], tree["cut"], depth), tree["prediction"]))
            weight = step if number else 1.0
            state = state.map(lambda b, last=last_trees, weight=weight: advance(b, *last[b[0]], weight)).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            if number % CUT_EVERY == CUT_EVERY - 1 and sc.getCheckpointDir():
                state.checkpoint()
        for i, squares in gathered(state.map(lambda b: (b[0], (b[5], None)))).items():
            grown[i][-1]["squares"] = squares[0]
    finally:
        for rdd in held:
            rdd.unpersist()
    for i, trees in enumerate(grown):
        table = np.zeros((n_features, max(1, *(len(t) for t in cuts[i]))))
        for f, t in enumerate(cuts[i]):
            table[f, :len(t)] = t
        for tree in trees:
            ss = tree.pop("squares").copy()
            for node in range((nodes - 1) // 2 - 1, -1, -1):
                if tree["feature"][node] >= 0:
                    ss[node] = ss[2 * node + 1] + ss[2 * node + 2]
            n, mean = np.maximum(tree["count"], 1), tree["prediction"]
            tree["threshold"] = table[np.maximum(tree["feature"], 0), tree.pop("cut")]
            tree["impurity"] = np.maximum(ss / n - mean * mean, 0.0)
            tree["stats"] = np.stack([tree["count"], tree.pop("sum"), ss], axis=1)
    return grown, n_features


# -- models -----------------------------------------------------------------------

def _metadata(spark, name: str, uid: str, params: dict, defaults: dict, **more) -> str:
    return json.dumps({"class": name, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": params,
                       "defaultParamMap": defaults, **more})


def native_model(estimator, spark, trees: list, n_features: int, weights: list):
    """MLlib's model of the trees, through its saved form."""
    import pyarrow as pa

    forest = isinstance(estimator, RandomForestClassifier)
    reader, one = (RandomForestClassificationModel, DecisionTreeClassifier) if forest else (GBTClassificationModel, DecisionTreeRegressor)
    known = {p.name for p in one().params}
    params, defaults = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    mine, mine_defaults = ({k: v for k, v in m.items() if k in known} for m in (params, defaults))
    mine["impurity"] = "gini" if forest else "variance"
    package, tree_class, short = ("classification", "DecisionTreeClassificationModel", "dtc") if forest else ("regression", "DecisionTreeRegressionModel", "dtr")
    heads = [(t, _metadata(spark, f"org.apache.spark.ml.{package}.{tree_class}", f"{short}_{estimator.uid}_{t}", mine, mine_defaults), float(w))
             for t, w in enumerate(weights)]
    columns: dict = {k: [] for k in ("tree", "id", "prediction", "impurity", "stats", "count", "gain", "left", "right", "feature", "threshold")}
    for t, tree in enumerate(trees):
        there = np.zeros(len(tree["feature"]), bool)
        there[0] = True
        for node in np.flatnonzero(tree["feature"] >= 0).tolist():   # heap order: parents first
            if there[node]:
                there[2 * node + 1] = there[2 * node + 2] = True
        at = np.flatnonzero(there)
        new = np.cumsum(there) - 1
        split = tree["feature"][at] >= 0
        child = np.where(split, 2 * at + 1, 0)
        columns["tree"].append(np.full(len(at), t, np.int32))
        columns["id"].append(np.arange(len(at), dtype=np.int32))
        columns["left"].append(np.where(split, new[child], -1).astype(np.int32))
        columns["right"].append(np.where(split, new[np.where(split, child + 1, 0)], -1).astype(np.int32))
        columns["gain"].append(np.where(split, tree["gain"][at], -1.0))
        columns["feature"].append(np.where(split, tree["feature"][at], -1).astype(np.int32))
        columns["threshold"].append(tree["threshold"][at])
        columns["count"].append(tree["count"][at].astype(np.int64))
        for k in ("prediction", "impurity", "stats"):
            columns[k].append(tree[k][at].astype(float))
    got = {k: np.concatenate(v) for k, v in columns.items()}
    n, width = got["stats"].shape
    ends = np.concatenate([[0], np.cumsum(got["feature"] >= 0)]).astype(np.int32)
    split = pa.StructArray.from_arrays([pa.array(got["feature"]), pa.ListArray.from_arrays(ends, got["threshold"][got["feature"] >= 0]),
                                        pa.array(np.full(n, -1, np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), got["stats"].reshape(-1))
    node = pa.StructArray.from_arrays([pa.array(got["id"]), pa.array(got["prediction"]), pa.array(got["impurity"]), stats, pa.array(got["count"]),
                                       pa.array(got["gain"]), pa.array(got["left"]), pa.array(got["right"]), split],
                                      ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    path = scratch_path(spark, "grown_trees")
    sizes = {"numFeatures": n_features, **({"numClasses": 2} if forest else {}), "numTrees": len(trees)}
    name = f"org.apache.spark.ml.classification.{reader.__name__}"
    spark.createDataFrame([(_metadata(spark, name, estimator.uid, params, defaults, **sizes),)], "value string").coalesce(1).write.text(path + "/metadata")
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(path + "/treesMetadata")
    spark.createDataFrame(pa.table({"treeID": pa.array(got["tree"]), "nodeData": node})).coalesce(1).write.parquet(path + "/data")
    return reader.load(path)


def native_models(estimator, frames: list, grown: list, n_features: int, weights: list) -> list:
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda f, trees: native_model(estimator, f.sparkSession, trees, n_features, weights), frames, grown))


class ForestLearner(RandomForestClassifier):
    """MLlib's forest (two classes, gini, bootstrap), grown by ``grow_forests``; a fitted model is MLlib's."""

    def fit_all(self, frames: list) -> list:
        """A model per frame; all are grown in the same jobs."""
        grown, n_features = grow_forests(self, frames)
        return native_models(self, frames, grown, n_features, [1.0] * self.getNumTrees())

    def _fit(self, df: DataFrame) -> RandomForestClassificationModel:
        return self.fit_all([df])[0]


class BoostedLearner(GBTClassifier):
    """MLlib's boosted trees (log loss, variance), grown by ``grow_boosted``; a fitted model is MLlib's."""

    def fit_all(self, frames: list) -> list:
        """A model per frame; all are grown in the same jobs."""
        grown, n_features = grow_boosted(self, frames)
        return native_models(self, frames, grown, n_features, [1.0] + [self.getStepSize()] * (self.getMaxIter() - 1))

    def _fit(self, df: DataFrame) -> GBTClassificationModel:
        return self.fit_all([df])[0]
