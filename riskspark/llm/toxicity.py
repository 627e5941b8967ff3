"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words and their stems, pairs of neighbouring words and pairs
with one word between (letters and digits only, A-Z lower-cased), hashed to ``DIM`` places. FTRL keeps one
learning rate per coordinate; its L1 term leaves most weights at exactly zero, so the model that
goes to the tasks is the list of non-zero weights (at most ``DIM`` of them, 8 MB).

The fit runs in one task over a bounded sample of the labelled training rows: about ``TRAIN_ROWS``
of them by a hash of doc_id (all, where there are fewer). Everything else covers all rows.

Defined cases: null and empty texts score as the bias alone; rows without doc_id are scored and
held out; without training rows every score is 0; repeated rows come back as often as given; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, in_part

DIM, TRAIN_ROWS, EPOCHS, BATCH, THRESHOLD = 1 << 20, 16_000, 4, 16, 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1
#: bytes of the stems that stand for a word beside the word itself, so that its endings are known too
STEMS = (4, 6, 7)
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every n-gram and skip-gram occurrence; place 0 is the bias."""
    w = T.words(data, off, breaks=_BREAK)
    doc, h = w.doc, w.hash
    docs, places = [doc], [h]
    for size in STEMS:
        long = w.end - w.start > size
        docs.append(doc[long])
        places.append(T.span_hash(data, w.start[long], w.start[long] + size) + T.U64(size))
    for gap, salt in ((1, 3), (2, 5)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        places.append((T.mix(h[:-gap] * T.U64(0x9E3779B97F4A7C15) + h[gap:] + T.U64(salt)))[same])
    return np.concatenate(docs), (np.concatenate(places) % T.U64(DIM - 1)).astype(np.int64) + 1


def _distinct(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * DIM + place)
    return both // DIM, both % DIM


class Ftrl:
    """State and mini-batch steps of FTRL-proximal; the bias (place 0) has no L1 term."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIM), np.zeros(DIM)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def step(self, doc: np.ndarray, place: np.ndarray, y: np.ndarray) -> None:
        at, where = np.unique(place, return_inverse=True)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[where], minlength=len(y)), -35, 35)))
        g = (p - y)[doc]
        total, squares = (np.bincount(where, weights=v, minlength=len(at)) for v in (g, g * g))
        grown = self.n[at] + squares
        self.z[at] += total - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _fit(batches):
    texts = []
    for batch in batches:
        order = np.arange(batch.num_rows)
        y = batch.column("y").to_numpy().astype(float)
        for a, b, data, off in T.slices(batch.column("text")):
            doc, place = _distinct(*hashed(data, off))
            first = np.searchsorted(doc, np.arange(b - a + 1))
            key = batch.column("key").to_numpy()
            texts += [(key[a + i], y[a + i], place[first[i] : first[i + 1]].astype(np.int32)) for i in order[: b - a]]
    texts.sort(key=lambda t: t[0])  # one order whatever the partitions were
    model = Ftrl()
    for _ in range(EPOCHS):
        for s in range(0, len(texts), BATCH):
            part = texts[s : s + BATCH]
            doc = np.concatenate([np.full(len(p) + 1, i) for i, (_, _, p) in enumerate(part)])
            place = np.concatenate([np.append(p, 0) for _, _, p in part]).astype(np.int64)
            model.step(doc, place, np.array([y for _, y, _ in part]))
    if texts:
        at = np.flatnonzero((np.abs(model.z) > L1) | (np.arange(DIM) == 0))
        w = model.weights(at)
        yield pa.record_batch({"place": pa.array(at[(w != 0) | (at == 0)]), "weight": pa.array(w[(w != 0) | (at == 0)])})


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and values of the non-zero weights; None without training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out)
    rows = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, TRAIN_ROWS / max(rows, 1)) * (1 << 30))
    train = id_text(docs).join(known.filter(share), "doc_id").select("text", "y", F.xxhash64("doc_id", F.lit(13), "y", "text").alias("key"))
    found = train.repartition(1).mapInArrow(_fit, "place long, weight double").collect()
    return (np.array([r.place for r in found]), np.array([r.weight for r in found])) if found else None


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, score) of every row, learned from labelled rows outside ``held_out``."""
    docs = id_text(docs)
    model = fit(docs, labels, held_out)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at, value = sent.value
        weight = np.zeros(DIM)
        weight[at] = value
        for batch in batches:
            for a, b, data, off in T.slices(batch.column(1)):
                doc, place = hashed(data, off)
                used = weight[place] != 0
                doc, place = _distinct(doc[used], place[used])
                raw = weight[0] + np.bincount(doc, weights=weight[place], minlength=b - a)
                yield pa.record_batch({"doc_id": batch.column(0)[a:b], "score": pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))})

    return docs.mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = F.coalesce(in_part(4, 2), F.lit(True))
    return score(docs, labels, out).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
