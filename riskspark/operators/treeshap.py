"""Path-dependent TreeSHAP (Lundberg, Erion & Lee, 2018), by leaves.

What a leaf adds to a row's values depends only on which of the distinct features on its
path send the row towards it: at most ``2 ** depth`` patterns. So each leaf gets a table of
the values of every pattern, which follows from the tree alone, and a row costs one
pattern number and one table row per leaf. Patterns are followed down the tree for all rows
of an Arrow batch at once. This is the per-batch body of a ``mapInPandas``; Spark distributes
the batches.

A pattern's values: with ``z`` a feature's share of the training weight that takes its branches
and ``o`` 1 where the row does, the Shapley value of feature ``i`` in a leaf is
``value * (o_i - z_i) * integral over t in (0, 1) of prod over k != i of (t o_k + (1 - t) z_k)``.
The product's degree in ``t`` is below the number of features, so Gauss-Legendre sums are exact.

Trees are plain NumPy node arrays: ``left``, ``right`` (-1 at leaves),
``feature``, ``threshold`` (row goes left when ``x <= threshold``), ``value``
(the leaf output being explained) and ``cover`` (training weight reaching the node).
"""

from __future__ import annotations

import numpy as np

#: numbers in the tables that are held at once
TABLE = 1 << 21
#: rows that are walked together
ROWS = 1 << 12


def expected_value(tree: dict) -> float:
    """Cover-weighted mean leaf value: the tree's output with no feature known."""
    leaves = tree["left"] < 0
    return float(np.sum(tree["value"][leaves] * tree["cover"][leaves]) / tree["cover"][0])


def pattern_tables(z: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(leaves, 2 ** d, d): what each of the d features of a path adds, by pattern (bit k: the row takes feature k's branches).

    ``z``: (leaves, d) shares of the training weight."""
    m, d = z.shape
    out = np.zeros((d, m, 1 << d))
    points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    for t, w in zip((points + 1) / 2, weights / 2):
        zero = (1 - t) * z
        one = zero + t
        product = (w * value)[:, None]
        for k in range(d):                           # bit k doubles the patterns
            product = np.concatenate([product * zero[:, k:k + 1], product * one[:, k:k + 1]], axis=1)
        # (o - z) over the feature's own factor, which the product has; z = 0 and o = 0 add nothing
        factor = np.stack([np.where(z > 0, -1 / (1 - t), 0.0), (1 - z) / one], axis=2)
        for k in range(d):
            by_bit = (m, 1 << d - k - 1, 2, 1 << k)
            out[k].reshape(by_bit)[...] += product.reshape(by_bit) * factor[:, k, None, :, None]
    return out.transpose(1, 2, 0)


def _paths(tree: dict) -> list:
    """(node, features, shares) of every leaf below the root, in the order of ``_codes``."""
    left, right, feat, cover = tree["left"], tree["right"], tree["feature"], tree["cover"]
    found, todo = [], [(0, (), ())]
    while todo:
        node, feats, z = todo.pop()
        if left[node] < 0:
            if feats:
                found.append((node, feats, z))
            continue
        f = int(feat[node])
        for child in (left[node], right[node]):
            share = cover[child] / cover[node] if cover[node] else 0.0
            if f in feats:
                k = feats.index(f)
                todo.append((child, feats, z[:k] + (z[k] * share,) + z[k + 1:]))
            else:
                todo.append((child, (*feats, f), (*z, share)))
    return found


def _codes(tree: dict, X: np.ndarray) -> dict:
    """Pattern of every row in every leaf, by node."""
    left, right, feat, thr = tree["left"], tree["right"], tree["feature"], tree["threshold"]
    found, todo = {}, [(0, (), np.zeros(len(X), np.int64))]
    columns = np.ascontiguousarray(X.T)
    while todo:
        node, feats, code = todo.pop()
        if left[node] < 0:
            found[node] = code
            continue
        f = int(feat[node])
        goes_left = (columns[f] <= thr[node]).astype(np.int64)
        k = feats.index(f) if f in feats else len(feats)
        if k == len(feats):
            feats = (*feats, f)
            todo += [(left[node], feats, code | goes_left << k), (right[node], feats, code | (1 - goes_left) << k)]
        else:                                        # both must hold
            mask = ~(1 << k)
            todo += [(left[node], feats, code & (mask | goes_left << k)), (right[node], feats, code & (mask | (1 - goes_left) << k))]
    return found


def tree_shap(tree: dict, X: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of one tree's output for the rows of ``X``."""
    n, n_features = X.shape
    phi = np.zeros((n, n_features))
    by_size: dict = {}
    for leaf in _paths(tree):
        by_size.setdefault(len(leaf[1]), []).append(leaf)
    parts = [(a, min(a + ROWS, n)) for a in range(0, n, ROWS)]
    codes = [_codes(tree, X[a:b]) for a, b in parts]
    for d, leaves in by_size.items():
        at_once = max(1, TABLE // ((1 << d) * n_features))
        for i in range(0, len(leaves), at_once):
            some = leaves[i:i + at_once]
            nodes = [x[0] for x in some]
            feats = np.array([x[1] for x in some])
            table = np.zeros((len(some), 1 << d, n_features))
            np.put_along_axis(table, np.broadcast_to(feats[:, None, :], (len(some), 1 << d, d)),
                              pattern_tables(np.array([x[2] for x in some], dtype=float), tree["value"][nodes]), axis=2)
            for (a, b), code in zip(parts, codes):
                got, held = phi[a:b], np.empty((b - a, n_features))
                for node, rows in zip(nodes, table):
                    got += np.take(rows, code[node], axis=0, out=held, mode="clip")
    return phi


def ensemble_shap(trees, weights, X: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted sum over trees: (phi, base value) of ``sum_t weight_t * tree_t(x)``."""
    phi = np.zeros(X.shape)
    base = 0.0
    for t, w in zip(trees, weights):
        phi += w * tree_shap(t, X)
        base += w * expected_value(t)
    return phi, base


def predict(trees, weights, X: np.ndarray) -> np.ndarray:
    """Ensemble output (for checks): follow each row to its leaf."""
    out = np.zeros(X.shape[0])
    for t, w in zip(trees, weights):
        node = np.zeros(X.shape[0], dtype=int)
        for _ in range(64):
            internal = t["left"][node] >= 0
            if not internal.any():
                break
            f = np.where(internal, t["feature"][node], 0).astype(int)
            go_left = X[np.arange(X.shape[0]), f] <= t["threshold"][node]
            node = np.where(internal, np.where(go_left, t["left"][node], t["right"][node]), node)
        out += w * t["value"][node]
    return out
