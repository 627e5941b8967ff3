"""Benchmark decontamination with spaced-seed hashes, DataFrame functions only.

Tokens are the runs of letters and digits of the lower-cased text. A mask lists the token offsets
that its seed keeps; the positions between are ignored, so a seed survives substitutions there.
Seeds of all documents meet those of all benchmark items; a hit fixes the item's alignment in the
document, and the alignment counts if some window of ``window`` item tokens (the whole item, if it
is shorter) has at least ``similarity`` of its tokens equal to the document's at the same places.

Items of at least ``window`` tokens are sought by ``MASKS``, shorter ones by ``SHORT_MASKS``. Both sets have a
seed in every window whose substitutions the similarity allows, at any positions (two in 10 to 13 tokens, one in 5 to 9),
so no link that the rule accepts is lost. Items of fewer than ``min_tokens`` tokens are never matched (a word or two
is no leak). Null and empty texts have no seeds. Repeated rows give one row per (doc_id, item_id). Empty tables give an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 5, 7, 9, 11))
#: for items shorter than the window
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
WINDOW, SIMILARITY, MIN_TOKENS = 13, 0.8, 5
#: benchmark seeds up to this size are broadcast; beyond it the seed join shuffles
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 48


def _tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t))


def _seeds(h: Column, n: Column, masks) -> Column:
    """One array: the seeds of every mask, one mask after another."""
    def of(k: int, m) -> Column:
        found = F.transform(F.sequence(F.lit(0), n - m[-1] - 1), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + o) for o in m]))
        return F.when(n > m[-1], found).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def _before(n: Column, masks) -> Column:
    """Array: how many seeds stand before those of each mask."""
    out = [F.lit(0)]
    for m in masks[:-1]:
        out.append(out[-1] + F.greatest(n - m[-1], F.lit(0)))
    return F.array(*out)


def leaks(docs: DataFrame, benchmark: DataFrame, masks=MASKS, short_masks=SHORT_MASKS, window: int = WINDOW, similarity: float = SIMILARITY,
          min_tokens: int = MIN_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_token, item_tokens, equal_tokens): documents that hold a benchmark passage.

    doc_token is where the item's first token falls (smallest verified alignment; negative if the
    item's head is missing), equal_tokens the most tokens equal on one verified alignment."""
    items = (benchmark.select(F.col("item_id").alias("item_id"), _tokens(F.col("text").cast("string")).alias("item"))
             .withColumn("m", F.size("item")).filter(F.col("m") >= min_tokens))
    long = len(masks)
    if items.filter(F.col("m") < window).limit(1).count():  # the short masks cost the documents seeds: only where an item needs them
        masks = (*masks, *short_masks)
    seeds = (items.select("item_id", "m", F.posexplode(_seeds(F.col("item"), F.col("m"), masks)).alias("at", "seed"), _before(F.col("m"), masks).alias("before"))
             .withColumn("mask", F.size(F.filter("before", lambda b: b <= F.col("at"))) - 1))
    # masks without seeds repeat an offset; the last mask of equal offsets is the one that has them
    seeds = seeds.filter((F.col("mask") < long) == (F.col("m") >= window)).select("seed", "item_id", "mask", (F.col("at") - F.get("before", F.col("mask"))).alias("item_at"))
    found = (docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _tokens(F.col("text").cast("string")).alias("h"))
             .withColumn("n", F.size("h")))
    place = lambda n: (F.col("at") - F.get(_before(n, masks), F.col("mask")) - F.col("item_at")).alias("diagonal")
    if seeds.count() * SEED_BYTES <= broadcast_bytes:
        hits = (found.select("doc_id", "h", "n", F.posexplode(_seeds(F.col("h"), F.col("n"), masks)).alias("at", "seed"))
                .join(F.broadcast(seeds), "seed").select("doc_id", "item_id", "h", place(F.col("n")))
                .join(F.broadcast(items), "item_id"))
    else:
        at = (found.select("doc_id", "n", F.posexplode(_seeds(F.col("h"), F.col("n"), masks)).alias("at", "seed"))
              .join(seeds, "seed").select("doc_id", "item_id", place(F.col("n"))).distinct())
        hits = at.join(found.select("doc_id", "h"), "doc_id").join(items, "item_id")
    same = lambda j: F.get(F.col("h"), F.col("diagonal") + j) == F.get(F.col("item"), j)
    equal = lambda start, n: F.size(F.filter(F.sequence(start, start + n - 1), same))
    wide = F.least(F.col("m"), F.lit(window))
    close = F.exists(F.sequence(F.lit(0), F.col("m") - wide), lambda i: equal(i, wide) >= F.ceil(wide * similarity))
    return (hits.filter(close).select("doc_id", "item_id", "diagonal", "m", equal(F.lit(0), F.col("m")).alias("equal"))
            .groupBy("doc_id", "item_id").agg(F.min("diagonal").alias("doc_token"), F.max("m").alias("item_tokens"), F.max("equal").alias("equal_tokens")))


def oracle(window: int = WINDOW, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> str:
    """DuckDB SQL of ``leaks`` over all alignments: every equal token gives one, no masks."""
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS dh FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, len(bh) AS m FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS bh FROM benchmark WHERE text IS NOT NULL)
      WHERE len(bh) >= {min_tokens}),
dt AS (SELECT doc_id, unnest(dh) AS token, unnest(range(0, len(dh))) AS i FROM d),
bt AS (SELECT item_id, m, unnest(bh) AS token, unnest(range(0, len(bh))) AS p FROM b),
a AS (SELECT doc_id, item_id, i - p AS diagonal, m FROM dt JOIN bt USING (token) GROUP BY ALL HAVING count(*) >= ceil(least(m, {window}) * {similarity})),
j AS (SELECT doc_id, item_id, diagonal, a.m, unnest(range(0, a.m)) AS p, bh, dh FROM a JOIN b USING (item_id) JOIN d USING (doc_id)),
q AS (SELECT doc_id, item_id, diagonal, m, p,
             CASE WHEN diagonal + p >= 0 AND diagonal + p < len(dh) AND dh[diagonal + p + 1] = bh[p + 1] THEN 1 ELSE 0 END AS eq FROM j),
v AS (SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS s FROM q),
r AS (SELECT doc_id, item_id, diagonal, m, sum(eq) AS e, max(CASE WHEN p + 1 >= least(m, {window}) THEN s END) AS best FROM v GROUP BY ALL)
SELECT doc_id, item_id, CAST(min(diagonal) AS INTEGER) AS doc_token, CAST(max(m) AS INTEGER) AS item_tokens, CAST(max(e) AS INTEGER) AS equal_tokens
FROM r WHERE best >= ceil(least(m, {window}) * {similarity}) GROUP BY doc_id, item_id
"""
