"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the words whose share of documents lies in a band of inverse document frequency,
counted over all documents. A share of at least ``LOW`` bounds its size: the shares of all words
add up to the mean number of distinct words of a text, so at most that mean / ``LOW`` words pass
(some MB), whatever the number of texts; that is what goes to every task. A text keeps its distinct
words of the band in sorted order, and each of ``SUBSETS`` random sub-lexicons (all of the lexicon, then
from a quarter of it to one word in 512) gives a 16-bit hash of the words kept: a fingerprint of 4 hex digits
per subset. A text without a word of the band uses all its words. The likeness of two fingerprints
is the share of equal hashes among subsets that keep a word of either text.

Defined cases: null and empty texts have the fingerprint of no words (all zeros, alike with each
other only); rows of equal doc_id follow each other in the order of a hash of their texts; a single
row is its own next row; repeated rows stay; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, keep

LOW, HIGH, SUBSETS = 0.0005, 0.2, 48
_SALT = T.mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * T.U64(0x51ED2701A94C8D43))
#: of 2**64: the first sub-lexicon is the whole lexicon, the others go from a quarter to one word in 512
_RATE = [(1 << 64) - 1] + [1 << (62 - i // 6) for i in range(1, SUBSETS)]


def _document_frequencies(batches):
    """(word, documents) of a task, summed before rows leave it."""
    terms, counts, held = [], [], 0

    def merged():
        u, inverse = np.unique(np.concatenate(terms), return_inverse=True)
        return u, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)

    for batch in batches:
        for a, b, data, off in T.slices(batch.column(0)):
            w = T.words(data, off)
            h, _ = T.distinct_sorted(w.doc, w.hash, b - a)
            u, c = np.unique(h, return_counts=True)
            terms.append(u)
            counts.append(c)
            held += len(u)
            if held > 2_000_000:
                u, c = merged()
                if len(u) > 1_000_000:
                    yield pa.record_batch({"word": pa.array(u.view(np.int64)), "docs": pa.array(c)})
                    u, c = u[:0], c[:0]
                terms, counts, held = [u], [c], len(u)
    if terms:
        u, c = merged()
        yield pa.record_batch({"word": pa.array(u.view(np.int64)), "docs": pa.array(c)})


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the words of the band."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = texts.count()
    words = texts.mapInArrow(_document_frequencies, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    found = words.filter((F.col("docs") >= low * n) & (F.col("docs") <= max(1.0, high * n))).select("word").toArrow()
    return np.sort(found["word"].to_numpy().view(np.uint64))


def hashes(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """(texts, SUBSETS) hashes; 0 where a subset keeps no word."""
    out = []
    for a, b, data, off in T.slices(texts):
        w = T.words(data, off)
        h, first = T.distinct_sorted(w.doc, w.hash, b - a)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        inside = words[at] == h if len(words) else np.zeros(len(h), bool)
        some = np.bincount(doc[inside], minlength=b - a) > 0
        use = inside | ~some[doc]
        h, doc = h[use], doc[use]
        got = np.zeros((b - a, SUBSETS), np.uint64)
        for i in range(SUBSETS):
            m = T.mix(h ^ _SALT[i])
            kept = m < T.U64(_RATE[i])
            total = np.zeros(kept.sum() + 1, np.uint64)
            np.cumsum(T.mix(m[kept]), out=total[1:])
            edge = np.searchsorted(doc[kept], np.arange(b - a + 1))
            s = total[edge[1:]] - total[edge[:-1]]
            got[:, i] = np.where(edge[1:] > edge[:-1], T.mix(s) % T.U64(0xFFFF) + T.U64(1), T.U64(0))
        out.append(got.astype(np.uint16))
    return np.concatenate(out) if out else np.zeros((0, SUBSETS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a != 0) | (b != 0)
    n = used.sum(axis=1)
    return np.where(n > 0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1), 1.0)


def _hex(h: np.ndarray) -> list[str]:
    raw = h.astype(">u2").tobytes().hex()
    return [raw[i : i + 4 * SUBSETS] for i in range(0, len(raw), 4 * SUBSETS)]


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = ", edge int, part int, text string"


def _rows(ids: list, texts: list[str], words: np.ndarray) -> dict:
    """Columns of all texts but the last, which is only the next one of its predecessor."""
    cut = [edited(t, n) for t, n in zip(texts[:-1], texts[1:], strict=True)]
    own = hashes(pa.array(texts, pa.large_string()), words)
    new = hashes(pa.array(cut, pa.large_string()), words)
    return {"doc_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in cut], "fingerprint": _hex(own[:-1]), "edited_fingerprint": _hex(new),
            "near_edited": pa.array(likeness(own[:-1], new)), "near_next": pa.array(likeness(own[:-1], own[1:]))}


def _packed(batches):
    """Texts compressed before they move: half of what the shuffle itself would make of them."""
    zip_ = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column(0), "zipped": pa.array([zip_(t.encode()) for t in batch.column(1).to_pylist()], pa.binary()), "tie": batch.column(2)})


def _in_order(sent):
    """Rows of a range in descending order; its first and last text meet their neighbours later."""

    def edge(kind: int, doc_id, text: str):
        none = {c.split()[0]: pa.nulls(1, pa.float64() if "double" in c else pa.string() if "string" in c else pa.int64()) for c in RESULT.split(", ")}
        return pa.record_batch(none | {"doc_id": pa.array([doc_id], pa.int64()), "edge": pa.array([kind], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "text": pa.array([text], pa.string())})

    def run(batches):
        words, last, unzip = sent.value, None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0)[s : s + 512].to_pylist(), [unzip(z).decode() for z in batch.column(1)[s : s + 512].to_pylist()]
                if last is None:
                    yield edge(0, ids[0], texts[0])
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = (ids[-1], texts[-1])
                if len(ids) > 1:
                    cols = _rows(ids, texts, words)
                    n = len(ids) - 1
                    yield pa.record_batch(cols | {"edge": pa.nulls(n, pa.int32()), "part": pa.nulls(n, pa.int32()), "text": pa.nulls(n, pa.string())})
        if last is not None:
            yield edge(1, *last)

    return run


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document (see RESULT)."""
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, low, high))
    packed = docs.withColumn("tie", F.xxhash64("text")).select("doc_id", "text", "tie").mapInArrow(_packed, "doc_id long, zipped binary, tie long")
    ranged = packed.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "tie").select("doc_id", "zipped")
    found = keep(ranged.mapInArrow(_in_order(sent), RESULT + _EDGE), "fingerprints", compression="zstd")
    parts = sorted(r.part for r in found.filter("edge = 0").select("part").collect())  # one number per task
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    ends = (found.filter("edge = 1").select("doc_id", "text", "part").join(after, "part")
            .join(found.filter("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part"))

    def meet(batches):
        words = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.record_batch(_rows([r["doc_id"], None], [r["text"], r["next_text"]], words))

    columns = [c.split()[0] for c in RESULT.split(", ")]
    return found.filter("edge is null").select(columns).unionByName(ends.select("doc_id", "text", "next_text").mapInArrow(meet, RESULT))
