"""MinHash near-dedup over bottom-k sketches of one hash function.

A document's set is its distinct runs of ``shingle`` words (A-Z lower-cased; a shorter text is one
shingle). Its sketch is the ``k`` smallest 64-bit shingle hashes. Texts with equal sets form a
class first, so copies never meet as pairs. Then, on one row per class:

1. inverted lists of retained values. Two sets of similarity ``s`` share at least ``t`` of their
   retained values (all of them where the sketch is the whole set; otherwise a binomial tail below
   1e-9), so they also meet in one of the ``k - t + 1`` rarest values of each: only those are
   listed, which leaves passages that many documents share out of nearly all lists;
2. each list links its members to its smallest one (a star, never all pairs); pairs are estimated
   on the union sketch (the k smallest of both sketches), then confirmed on the full sets;
3. members that are still in different components are compared once more inside each list, in
   blocks of bounded size, with a bound that never underestimates: the parity bitmaps of the full
   sets differ in at most as many bits as the sets differ in shingles. Only pairs that pass are
   emitted, estimated and confirmed like the first ones, so no link that changes a component is lost;
4. components of the confirmed links, by star rounds.

Defined cases: null, empty and blank texts have empty sets, link with nothing and stay; rows with
a null doc_id come back with a null component and stay; repeated rows come back as often as they
are given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, keep, list_array, map_batches
from riskspark.llm.components import components

K, SHINGLE, PERCENT = 64, 5, 85
BITS, BLOCK = 1024, 2048


def least_shared(k: int, percent: int, miss: float = 1e-9) -> int:
    """Largest t with P(Binomial(k, percent/100) < t) <= ``miss``."""
    p, total, term = percent / 100, 0.0, (1 - percent / 100) ** k
    for t in range(k + 1):
        total += term
        if total > miss:
            return t
        term *= (k - t) / (t + 1) * p / (1 - p)
    return k


def _sets(batch: pa.RecordBatch, shingle: int):
    for a, b, data, off in T.slices(batch.column(1)):
        doc, h = T.shingles(T.words(data, off), shingle)
        values, first = T.distinct_sorted(doc, h.view(np.int64), b - a)  # ascending as signed numbers, as SQL sorts them
        yield a, b, values.view(np.uint64), first

def _prefix_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=c[1:])
    return (c[first[1:]] - c[first[:-1]]).view(np.int64)


def _bitmaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity bitmap of each set: every shingle flips one of BITS bits."""
    n = len(first) - 1
    bit = (T.mix(values) % T.U64(BITS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    odd = (np.bincount(doc * BITS + bit, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1)


SIGNATURE = "doc_id long, n long, fp1 long, fp2 long, sketch array<long>, bitmap binary"


def _signatures(k: int, shingle: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for a, b, values, first in _sets(batch, shingle):
            n = np.diff(first)
            small = (np.arange(len(values)) - np.repeat(first[:-1], n)) < k
            bits = _bitmaps(values, first)
            out.append(pa.record_batch({
                "doc_id": batch.column(0)[a:b], "n": pa.array(n, pa.int64()), "fp1": pa.array(_prefix_sum(T.mix(values + T.U64(11)), first)),
                "fp2": pa.array(_prefix_sum(T.mix(values ^ T.U64(0xABCDEF)), first)), "sketch": list_array(values[small].view(np.int64), np.concatenate(([0], np.cumsum(np.minimum(n, k))))),
                "bitmap": pa.array([x.tobytes() for x in bits], pa.binary())}))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return run


def _full_sets(shingle: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for a, b, values, first in _sets(batch, shingle):
            out.append(pa.record_batch({"id": batch.column(0)[a:b], "fp": pa.array(_prefix_sum(T.mix(values + T.U64(11)), first)),
                                        "shingles": list_array(values.view(np.int64), first)}))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return run


def _close_in_lists(percent: int):
    """Pairs of different components in each (list, block) whose sets can be similar enough."""

    def pairs(t: dict) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        order = np.argsort(t["n"], kind="stable")
        side, comp, n, ids = (t[c][order] for c in ("side", "comp", "n", "class_id"))
        bits = t["bitmap"][order]
        for i in range(len(ids)):  # sizes ascend: partners of i end where n > n[i] * 100 / percent
            end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            j = np.arange(i + 1, end)
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = n[j] + n[i]
                j = j[100 * (both - apart) >= percent * (both + apart)]
                left.append(np.full(len(j), ids[i]))
                right.append(ids[j])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            yield from cut(t, False)
            rest = run.rest
        if rest is not None and rest.num_rows:
            yield from cut(pa.Table.from_batches([rest]), True)

    def cut(t: pa.Table, last: bool):
        cols = {c: t[c].to_numpy() for c in ("value", "block", "side", "comp", "n", "class_id")}
        bitmap = np.frombuffer(b"".join(t["bitmap"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        new = np.flatnonzero((np.diff(cols["value"]) != 0) | (np.diff(cols["block"]) != 0)) + 1
        edge = np.concatenate(([0], new, [t.num_rows]))
        left, right = [], []
        for s, e in zip(edge[:-1] if last else edge[:-2], edge[1:] if last else edge[1:-1], strict=True):
            if e - s > 1:
                a, b = pairs({c: v[s:e] for c, v in cols.items()} | {"bitmap": bitmap[s:e]})
                left.append(a)
                right.append(b)
        run.rest = None if last else t.slice(edge[-2]).combine_chunks().to_batches()[0] if t.num_rows else None
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            ab = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)
            if len(ab):
                yield pa.record_batch({"a": pa.array(ab[:, 0]), "b": pa.array(ab[:, 1])})

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that pass the union-sketch estimate and then the exact test on the full sets."""
    end = lambda df, x: df.select(*[F.col(c).alias(f"{x}_{c}" if c != "class_id" else x) for c in df.columns])
    small = nodes.select("class_id", "sketch")
    p = pairs.join(end(small, "a"), "a").join(end(small, "b"), "b")
    both = F.slice(F.sort_array(F.array_union("a_sketch", "b_sketch")), 1, k)
    shared = F.size(F.array_intersect("union", F.array_intersect("a_sketch", "b_sketch")))
    whole = F.size("union") < k
    p = (p.withColumn("union", both).withColumn("shared", shared)
         .filter((whole & (F.col("shared") * 100 >= F.size("union") * percent)) | (~whole & (F.col("shared") >= least_shared(k, percent)))).select("a", "b"))
    p = p.join(end(sets, "a"), "a").join(end(sets, "b"), "b")
    inter = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return (p.withColumn("inter", inter).filter(F.col("inter") * 100 >= (F.size("a_shingles") + F.size("b_shingles") - F.col("inter")) * percent)
            .select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = id_text(docs)
    sigs = keep(map_batches(docs, _signatures(k, shingle), SIGNATURE), "signatures")
    same = ["n", "fp1", "fp2"]
    some = sigs.filter("n > 0 and doc_id is not null")
    classes = some.groupBy(*same).agg(F.min("doc_id").alias("class_id"))
    member = keep(some.select("doc_id", *same).join(classes, same), "classes")
    reps = sigs.join(member.filter("doc_id = class_id").select("class_id", *same).distinct(), same).filter("doc_id = class_id").dropDuplicates(["class_id", "fp1"])

    t = least_shared(k, percent)
    posted = reps.select("class_id", "n", F.explode("sketch").alias("value"))
    often = posted.groupBy("value").count().filter("count > 1")
    held = F.least(F.col("n"), F.lit(k))
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(held, F.lit(t)))
    lists = (posted.join(often, "value").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("shared"))
             .withColumn("room", held - need + 1 - (held - F.size("shared"))).filter("room > 0")
             .select("class_id", F.explode(F.slice("shared", 1, F.col("room").cast("int"))).alias("s")).select("class_id", F.col("s.value").alias("value")))
    lists = keep(lists, "lists")
    size = lists.groupBy("value").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("top"), F.count("*").alias("members")).filter("leader < top")
    lists = lists.join(size, "value").drop("top")
    nodes = keep(reps.join(lists.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "n", "fp1", "sketch", "bitmap"), "nodes")
    held_sets = map_batches(docs.join(nodes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), _full_sets(shingle), "id long, fp long, shingles array<long>")
    sets = keep(held_sets.join(nodes.select(F.col("class_id").alias("id"), F.col("fp1").alias("fp")), ["id", "fp"]).dropDuplicates(["id", "fp"])
                .select(F.col("id").alias("class_id"), "shingles"), "sets")

    small = nodes.select("class_id", "n")
    star = (lists.filter("class_id != leader").select(F.col("class_id").alias("a"), F.col("leader").alias("b")).distinct()
            .join(small.withColumnsRenamed({"class_id": "a", "n": "na"}), "a").join(small.withColumnsRenamed({"class_id": "b", "n": "nb"}), "b")
            .filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b"))
    links = keep(_confirmed(star, nodes, sets, k, percent), "links")
    found = components(links)

    comp = nodes.select("class_id", "n", "bitmap").join(found.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("comp", F.coalesce("component", "class_id")).drop("component")
    rows = lists.join(comp, "class_id")
    mixed = rows.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("value")
    parts = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    rows = (rows.join(mixed, "value").withColumn("parts", parts).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("block", F.least("mine", "other").cast("long") * F.col("parts") + F.greatest("mine", "other"))
            .withColumn("side", F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)))
    rows = (rows.select("value", "block", "side", "comp", "n", "class_id", "bitmap").repartition("value", "block").sortWithinPartitions("value", "block"))
    cross = rows.mapInArrow(_close_in_lists(percent), "a long, b long").distinct()
    more = _confirmed(cross, nodes, sets, k, percent)
    linked = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    named = member.join(linked.withColumnRenamed("id", "class_id"), "class_id", "left").select("doc_id", *same, F.coalesce("component", "class_id").alias("component_id")).distinct()
    out = sigs.select("doc_id", *same).join(named, ["doc_id", *same], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 5 THEN array_to_string(a, ' ') ELSE array_to_string(a[i + 1 : i + 5], ' ') END AS g
      FROM (SELECT doc_id, a, unnest(range(0, greatest(len(a) - 4, CASE WHEN len(a) > 0 THEN 1 ELSE 0 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS root, doc_id AS x FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.x),
m AS (SELECT root AS doc_id, min(x) AS component_id FROM r GROUP BY root)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
