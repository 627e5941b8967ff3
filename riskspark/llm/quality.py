"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Every text becomes ``FEATURES`` statistics of its bytes and words (never its id, language, source
or labels). Labelled training rows give their standardisation; ``DIM`` random cosines approximate a
Gaussian kernel; normal equations are summed per partition and solved as a ridge regression. Scores
of the two halves of the training rows, each by the fit to the other half, are binned and made
monotone (isotonic regression), which maps every score to a probability of label 1.

Defined cases: null and empty texts have zero statistics and are scored like others; rows without
doc_id are scored and held out; without training rows of any label every score is 0.5; repeated
rows come back as often as given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, in_part, keep, list_array

DIM, WIDTH, RIDGE, BINS, THRESHOLD = 256, 3.0, 1.0, 1024, 0.3
FEATURES = 22
_UPPER, _LOWER, _DIGIT = ((np.arange(256) >= a) & (np.arange(256) <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_HIGH = np.arange(256) >= 128
_END = np.isin(np.arange(256), [0x2E, 0x2C, 0x3B, 0x3A, 0x3F])
_LETTER = _UPPER | _LOWER | _HIGH
_SYMBOL = ~(_LETTER | _DIGIT | _END | (np.arange(256) <= 32))


def _per(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0.0], np.cumsum(flags, dtype=np.float64)))
    return c[first[1:]] - c[first[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) statistics of a slice of texts."""
    w = T.words(data, off)
    first, n = w.first, np.diff(w.first)
    size = np.diff(off)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    tail = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    head = data[w.start] if len(w.start) else tail
    length = (w.end - w.start).astype(float)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    no_letter = letters[w.end] == letters[w.start]
    shout = (upper[w.end] - upper[w.start] >= 2) & (upper[w.end] - upper[w.start] >= letters[w.end] - letters[w.start] - 2)
    doc = w.doc
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    sh, sd = w.hash[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    runs = np.flatnonzero(new)
    count = np.diff(np.append(runs, len(sh)))
    most = np.zeros(len(n))
    np.maximum.at(most, sd[runs], count)
    lines = _per(data == 0x0A, off) + 1
    length_mean = _per(length, first) / per_word
    out = [
        np.log1p(n), np.log1p(size), length_mean, np.sqrt(np.maximum(_per(length * length, first) / per_word - length_mean**2, 0)),
        _per(_UPPER[data], off) / per_byte, _per(_DIGIT[data], off) / per_byte, _per(_SYMBOL[data], off) / per_byte, _per(_END[data], off) / per_byte,
        _per(_HIGH[data], off) / per_byte, _per(data <= 32, off) / per_byte, _per(no_letter, first) / per_word, _per(shout, first) / per_word,
        _per(_SYMBOL[tail], first) / per_word, _per(_END[tail], first) / per_word, _per(_UPPER[head], first) / per_word, _per(_SYMBOL[head], first) / per_word,
        _per(length <= 3, first) / per_word, _per(length >= 16, first) / per_word, _per(new[np.argsort(order)] if len(order) else new, first) / per_word,
        most / per_word, _per(same, first) / per_word, np.log1p(n / lines)]
    return np.stack(out, 1).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in T.slices(batch.column(1)):
                x = statistics(data, off)
                yield pa.record_batch({"doc_id": batch.column(0)[a:b], "x": list_array(x.astype(np.float32).ravel(), np.arange(b - a + 1) * FEATURES)})

    return id_text(docs).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), FEATURES)


def _cosines(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(4))
    turn, shift = rng.standard_normal((FEATURES, DIM)) / WIDTH, rng.uniform(0, 2 * np.pi, DIM)
    z = np.cos(np.clip((x - mean) / sd, -8, 8) @ turn + shift) * np.sqrt(2 / DIM)
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def _equations(train: DataFrame, mean: np.ndarray, sd: np.ndarray) -> list[np.ndarray]:
    """Per half, [Z'Z | Z'y]: summed in each partition, then in eight tasks, then here."""
    shape = (2, DIM + 1, DIM + 2)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            z, y, half = _cosines(_matrix(batch.column("x")), mean, sd), batch.column("y").to_numpy().astype(float), batch.column("half").to_numpy()
            for h in (0, 1):
                zh = z[half == h]
                total[h] += zh.T @ np.concatenate([zh, y[half == h][:, None]], 1)
        yield pa.record_batch({"m": pa.array([total.tobytes()], pa.binary())})

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m).reshape(shape)
        yield pa.record_batch({"m": pa.array([total.tobytes()], pa.binary())})

    parts = train.mapInArrow(run, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    return list(sum((np.frombuffer(r.m).reshape(shape) for r in parts), np.zeros(shape)))


def _solve(e: np.ndarray) -> np.ndarray:
    penalty = np.eye(DIM + 1) * RIDGE
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(e[:, :-1] + penalty, e[:, -1])


def isotonic(centre: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins with weights and sums of labels; returns knots (score, value)."""
    blocks: list[list[float]] = []
    for c, n, s in zip(centre, weight, total, strict=True):
        blocks.append([n, s, c * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _scorer(mean, sd, weights, knots, values):
    def run(batches):
        for batch in batches:
            raw = _cosines(_matrix(batch.column("x")), mean, sd) @ weights
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(np.clip(np.interp(raw, knots, values), 0, 1))})

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, score) of every row, learned from labelled rows outside ``held_out`` (a condition on doc_id)."""
    x = keep(features(docs), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    train = x.join(known, "doc_id").filter(~held_out).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    train = keep(train.select("x", "y", "half"), "features")
    sums = train.agg(F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(FEATURES)],
                     *[F.stddev_pop(F.get("x", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(FEATURES)]).first()
    if not sums.n:
        return x.select("doc_id", F.lit(0.5).alias("score"))
    mean = np.array([sums[f"m{i}"] for i in range(FEATURES)])
    sd = np.array([sums[f"s{i}"] or 1.0 for i in range(FEATURES)])
    e = _equations(train, mean, sd)
    other = [_solve(e[1]), _solve(e[0])]

    def binned(batches):
        out = np.zeros((2, BINS))
        for batch in batches:
            z, y, half = _cosines(_matrix(batch.column("x")), mean, sd), batch.column("y").to_numpy(), batch.column("half").to_numpy()
            raw = np.where(half == 0, z @ other[0], z @ other[1])
            at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(int)
            out += [np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]
        yield pa.record_batch({"bin": pa.array(np.arange(BINS)), "n": pa.array(out[0]), "s": pa.array(out[1])})

    bins = train.mapInArrow(binned, "bin long, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0").collect()
    bins.sort(key=lambda r: r.bin)
    knots, values = isotonic(np.array([(r.bin + 0.5) / BINS * 3 - 1 for r in bins]), np.array([r.n for r in bins]), np.array([r.s for r in bins]))
    return x.mapInArrow(_scorer(mean, sd, _solve(e[0] + e[1]), knots, values), "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = F.coalesce(in_part(5, 0), F.lit(True))
    return score(docs, labels, out).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
