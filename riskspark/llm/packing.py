"""Packing by order-preserving dynamic programming with monotone-queue transitions.

Documents stand in the order of doc_id, each as its subword ids and an end id. Windows of at most
``LENGTH`` ids are cut from that stream; the cuts lie at ends of documents, ends of sentences or,
inside a stretch without either, every ``STRETCH`` ids. The cost of a window is its padding (none
if its length is a power of two, else up to ``LENGTH``) plus what its last cut breaks: nothing, a
document or a sentence. The least ``cost(i) + place(i)`` over the window's reach is the head of a
monotone queue, so each place costs constant time; the powers of two are looked up directly.

The stream is cut into ranges of doc_id, one per task, and each task plans ``SEGMENT`` ids at a
time: it keeps all windows but the last few and plans on from there, so memory is bounded.

Defined cases: null and empty texts are the end id alone; ties of doc_id stand in the order of
their texts; repeated rows are packed as often as given; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text
from riskspark.llm.subwords import Subwords, texts_of

LENGTH, END_ID, STRETCH, SEGMENT = 2048, 1, 128, 1 << 20
BREAK_DOCUMENT, BREAK_SENTENCE = 12.0, 96.0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(own: Subwords) -> np.ndarray:
    """Per id: a sentence may end after it."""
    names = [own.tokenizer.id_to_token(i) or "" for i in range(own.tokenizer.get_vocab_size())]
    return np.array([n[-1:] in ".!?" and n != "" or "Ċ" in n for n in names])


def places(ids: np.ndarray, doc_end: np.ndarray, ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut places of a stream and what each breaks; doc_end: places where documents end."""
    cost = np.full(len(ids) + 1, -1.0)
    stop = ends[ids]
    stop[:-1] &= ~stop[1:]
    cost[np.flatnonzero(stop) + 1] = BREAK_DOCUMENT
    cost[doc_end] = 0.0
    cost[[0, len(ids)]] = 0.0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    for i in np.flatnonzero(gap > stretch):
        cost[at[i] + stretch : at[i + 1] : stretch] = BREAK_SENTENCE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cut places of the cheapest windows over places ``at`` (from the first to the last one)."""
    place, fee = at.tolist(), cost.tolist()
    index = np.full(place[-1] - place[0] + 1, -1, np.int32)
    index[at - place[0]] = np.arange(len(at))
    later, earlier = [], []  # places a power of two apart, the smallest first
    for q in (1 << k for k in range(length.bit_length())):
        j = np.flatnonzero(at - q >= place[0])
        i = index[at[j] - q - place[0]]
        later.append(j[i >= 0])
        earlier.append(i[i >= 0])
    later = np.concatenate(later)
    order = np.argsort(later, kind="stable")
    first = np.searchsorted(later[order], np.arange(len(at) + 1)).tolist()
    earlier = np.concatenate(earlier)[order].tolist()
    best, back = [0.0] * len(place), [0] * len(place)
    keys = [float(place[0])] * len(place)  # a place's cost and itself
    queue: deque[int] = deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        low = keys[i] + length - p
        for k in earlier[first[j] : first[j + 1]]:
            if best[k] < low:
                low, i = best[k], k
        best[j], back[j] = low + fee[j], i
        keys[j] = key = best[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1]


def _pack(path: str | None, length: int):
    def run(batches):
        own = Subwords.of(path)
        ends = sentence_ends(own)
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, first id held, ids from there, all its ids
        size, sequence = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def flush(last: bool):
            nonlocal held, size, sequence
            ids = np.concatenate([h[2] for h in held])
            stop = np.cumsum([len(h[2]) for h in held])
            cuts = plan(*places(ids, stop, ends), length)
            if not last:
                cuts = cuts[:-4]
            rows, begin, d, base = [], 0, 0, 0
            for cut in cuts:
                s = begin
                while s < cut:
                    e = min(cut, int(stop[d]))
                    doc_id, first, _, total = held[d]
                    rows.append((doc_id, first + s - base, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes()), total, sequence, s - begin))
                    if e == stop[d]:
                        d, base = d + 1, e
                    s = e
                begin, sequence = cut, sequence + 1
            rest = held[d:]
            if rest:
                doc_id, first, own_ids, total = rest[0]
                rest[0] = (doc_id, first + begin - base, own_ids[begin - base :], total)
            held, size = rest, len(ids) - begin
            cols = list(zip(*rows, strict=True))
            return pa.record_batch({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(PIECES.split(", "), cols, strict=True)})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts_of(batch.column(1), path), strict=True):
                ids = np.append(ids, np.uint16(END_ID))
                for s in range(0, len(ids), SEGMENT):
                    held.append((doc_id, s, ids[s : s + SEGMENT], len(ids)))
                    size += len(held[-1][2])
                    if size >= SEGMENT:
                        yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence (see PIECES)."""
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_pack(tokenizer_path, length), PIECES)
