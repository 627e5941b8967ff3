"""Substring dedup by text, paragraph, line and sentence hashing, with original offsets.

Units are runs of words: whole texts and their paragraphs, lines and sentences. A paragraph ends at white
space with two line feeds or more, a line at a line feed, a sentence also at a word whose last byte is ``.``, ``!``
or ``?`` (the longest pieces that a copied passage shares with its source whatever stands around it on
the line: pasted passages need not fill whole lines). A unit's digest covers its words, lower-cased,
whatever the white space between. Digests are grouped over all documents and kinds; of equal units the
one with the smallest (doc_id, unit number) stays, each other one is removed.

Whole texts are units at any length, the others from ``min_words`` words. A shorter line is hashed together
with the lines after it until there are ``min_words`` words, and in a second unit with the lines before it. So of any run
of whole lines that is copied and has ``min_words`` words, every line is removed, however short: a line whose words to the
run's end are too few lies in the unit that ends with the run's last line. Only a short line or sentence that repeats between
lines that do not stays. Of removed units that lie inside each other the longest is listed; units of joined lines may
overlap, and what they cover together is what is removed.

Defined cases: null and empty texts and rows without doc_id have no units; rows of equal doc_id
count as one document (equal units at equal numbers are one occurrence); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, map_batches

MIN_WORDS = 6
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F]] = True


def _joined(begin: np.ndarray, stop: np.ndarray, doc: np.ndarray, least: int) -> list[np.ndarray]:
    """Short lines with the lines of their document after them, and before them, up to ``least`` words."""
    short = np.flatnonzero(stop - begin < least)
    after = np.searchsorted(stop, begin[short] + least)
    before = np.searchsorted(begin, stop[short] - least, "right") - 1
    on, back = after < len(doc), before >= 0
    on[on] = doc[after[on]] == doc[short[on]]
    back[back] = doc[before[back]] == doc[short[back]]
    return [begin[short[on]] << 32 | stop[after[on]], begin[before[back]] << 32 | stop[short[back]]]


def _units(least: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, out = batch.column(0), []
        for a, b, data, off in T.slices(batch.column(1)):
            w = T.words(data, off)
            n = len(w.start)
            if not n:
                continue
            feeds = np.concatenate(([0], np.cumsum(data == 0x0A)))
            breaks = np.minimum(feeds[np.append(w.start[1:], len(data))] - feeds[w.end], 2)
            breaks[w.first[1:][w.first[1:] > 0] - 1] = 3
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            kinds = [np.flatnonzero(last) + 1 for last in (breaks > 2, breaks > 1, breaks > 0, (breaks > 0) | _STOP[data[w.end - 1]])]
            runs = [np.concatenate(([0], stop[:-1])) << 32 | stop for stop in kinds]
            line = runs[2] >> 32
            runs += _joined(line, kinds[2], np.searchsorted(w.first, line, "right") - 1, least)
            runs = np.unique(np.concatenate(runs))  # runs that are units of several kinds count once
            begin, stop = runs >> 32, runs & 0xFFFFFFFF
            doc = np.searchsorted(w.first, begin, "right") - 1
            counted = (stop - begin >= least) | ((begin == w.first[doc]) & (stop == w.first[doc + 1]))
            begin, stop, doc = begin[counted], stop[counted], doc[counted]
            digest = T.span_of(w.hash, begin, stop)
            first = np.searchsorted(doc, np.arange(b - a))
            base = chars[off[doc]]
            out.append(pa.record_batch({
                "doc_id": ids.take(pa.array(doc + a)), "unit": pa.array(np.arange(len(doc)) - first[doc], pa.int64()), "digest": pa.array(digest.view(np.int64)),
                "words": pa.array(stop - begin, pa.int32()), "start": pa.array(chars[w.start[begin]] - base, pa.int64()), "end": pa.array(chars[w.end[stop - 1]] - base, pa.int64())}))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return run


UNITS = "doc_id long, unit long, digest long, words int, start long, end long"


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: (doc_id, unit, start, end, words, kept_doc_id), offsets in code points."""
    units = map_batches(id_text(docs).filter("doc_id is not null and text is not null"), _units(min_words), UNITS)
    rank = (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("unit")).cast("decimal(38,0)")
    units = units.withColumn("rank", rank)
    first = (units.groupBy("digest", "words").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.min("doc_id").alias("kept_doc_id"))
             .filter("last > first").drop("last"))
    removed = units.join(first, ["digest", "words"]).filter("rank > first").select("doc_id", "unit", "start", "end", "words", "kept_doc_id").distinct()
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "unit").rowsBetween(Window.unboundedPreceding, -1))
    return removed.withColumn("before", before).filter("before is null or end > before").drop("before")


def oracle() -> str:
    """SQL of the same units by their words instead of digests."""
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(' ' || text, '[\x20\x09-\x0D]+') AS gap
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(gap[1:len(w)]) AS gap, unnest(list_append(gap[2:len(w)], '')) AS next FROM t WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, i, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, i = n AS ends,
      sum(length(gap) + length(word)) OVER before - 1 AS stop, sum(length(gap) + length(word)) OVER before - 1 - length(word) AS start,
      length(next) - length(replace(next, chr(10), '')) AS feeds, right(word, 1) IN ('.', '!', '?') AS full_stop
      FROM x WINDOW before AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, unnest([1, 2, 3, 4]) AS kind, unnest([ends, ends OR feeds >= 2, ends OR feeds >= 1, ends OR feeds >= 1 OR full_stop]) AS last FROM p),
r AS MATERIALIZED (SELECT doc_id, kind, coalesce(lag(i) OVER (PARTITION BY doc_id, kind ORDER BY i), 0) + 1 AS a, i AS b FROM k WHERE last),
l AS MATERIALIZED (SELECT doc_id, a, b FROM r WHERE kind = 3),
u AS (SELECT doc_id, a, b FROM r WHERE b - a >= {MIN_WORDS - 1} OR kind = 1
      UNION SELECT s.doc_id, s.a, m.b FROM (SELECT *, a + {MIN_WORDS - 1} AS reach FROM l WHERE b - a < {MIN_WORDS - 1}) s ASOF JOIN l m ON s.doc_id = m.doc_id AND s.reach <= m.b
      UNION SELECT s.doc_id, m.a, s.b FROM (SELECT *, b - {MIN_WORDS - 1} AS reach FROM l WHERE b - a < {MIN_WORDS - 1}) s ASOF JOIN l m ON s.doc_id = m.doc_id AND s.reach >= m.a),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS unit FROM u),
g AS (SELECT v.doc_id, v.unit, v.a, v.b, string_agg(p.word, ' ' ORDER BY p.i) AS words
      FROM (SELECT *, unnest(range(a, b + 1)) AS i FROM v) v JOIN p ON p.doc_id = v.doc_id AND p.i = v.i GROUP BY ALL),
f AS (SELECT doc_id, unit, a, b, first_value(doc_id) OVER same AS kept_doc_id, row_number() OVER same AS place FROM g WINDOW same AS (PARTITION BY words ORDER BY doc_id, unit)),
o AS (SELECT f.doc_id, f.unit, s.start, e.stop, f.b - f.a + 1 AS words, f.kept_doc_id FROM f
      JOIN p s ON s.doc_id = f.doc_id AND s.i = f.a JOIN p e ON e.doc_id = f.doc_id AND e.i = f.b WHERE f.place > 1),
z AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM o)
SELECT doc_id, unit, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", words, kept_doc_id FROM z WHERE reached IS NULL OR stop > reached
"""
