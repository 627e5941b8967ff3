"""Line dedup by overlapping three-line windows.

Lines are the pieces of a text between line feeds. Every run of ``size`` consecutive lines is
hashed; of a window that occurs more than once, the occurrence with the smallest (doc_id, line)
stays and each later one covers its lines. Covered lines, merged over all windows, go.

Defined cases: a null text is empty (one empty line); a text of fewer than ``size`` lines has no
window and is kept whole; windows of blank lines alone are ignored; overlapping repeats within a
text (``a a a a``) keep the lines before the first later window. Rows with a null doc_id pass
unchanged. Rows of equal doc_id count as one document at equal positions. An empty table gives an
empty result; extra columns are kept as they are (but ``_n_lines`` and ``_removed``, which the result sets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK = "decimal(38,0)"


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))


def later_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, pos): first line of every window that occurred before at a smaller (doc_id, line)."""
    n = F.size("lines")
    runs = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.when(
        F.trim(F.concat(*[F.get("lines", i + j) for j in range(size)])) != "",
        F.xxhash64(F.concat_ws("\n", *[F.get("lines", i + j) for j in range(size)])))))
    seen = (_lines(docs).filter("doc_id is not null").select("doc_id", F.posexplode(runs).alias("pos", "h")).filter("h is not null")
            .withColumn("rank", (F.col("doc_id").cast(RANK) * F.lit(1 << 32).cast("decimal(12,0)") + F.col("pos")).cast(RANK)))
    first = seen.groupBy("h").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).filter("last > first")
    return seen.join(first.select("h", "first"), "h").filter("rank > first").select("doc_id", "pos")


def dedup_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` with the text of kept lines, and ``_n_lines``, ``_removed`` (line numbers, ascending)."""
    covered = (later_windows(docs, size).groupBy("doc_id")
               .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array(*[F.col("pos") + j for j in range(size)]))))).alias("removed"))
               .withColumnRenamed("doc_id", "covered_id"))
    kept = [c for c in docs.columns if c not in ("_n_lines", "_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))  # whatever the columns are called
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    rows = rows.join(covered, F.col("row.doc_id") == F.col("covered_id"), "left").withColumn("lines", lines)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept], F.size("lines").alias("_n_lines"),
                       F.coalesce("removed", F.array().cast("array<int>")).alias("_removed"))


def query(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row per document: its lines, the removed line numbers and the text that stays."""
    out = dedup_lines(docs.select("doc_id", "text"), size)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.size("_removed").alias("n_removed"),
                      F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed_lines"), "text")


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
w AS (SELECT doc_id, i AS pos, a[i + 1] || chr(10) || a[i + 2] || chr(10) || a[i + 3] AS k
      FROM (SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS i FROM l)
      WHERE trim(a[i + 1] || a[i + 2] || a[i + 3], ' ') <> ''),
f AS (SELECT k, min(row(doc_id, pos)) AS fst FROM w GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM w JOIN f USING (k) WHERE row(doc_id, pos) > fst),
e AS (SELECT doc_id, a[i + 1] AS s, i AS line FROM (SELECT doc_id, a, unnest(range(0, len(a))) AS i FROM l)),
g AS (SELECT e.doc_id, string_agg(s, chr(10) ORDER BY e.line) FILTER (c.line IS NULL) AS t,
             string_agg(CAST(c.line AS VARCHAR), ',' ORDER BY c.line) FILTER (c.line IS NOT NULL) AS r, count(c.line) AS n
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.line = c.line GROUP BY e.doc_id)
SELECT l.doc_id, CAST(len(a) AS INTEGER) AS n_lines, CAST(g.n AS INTEGER) AS n_removed, coalesce(r, '') AS removed_lines,
       CASE WHEN g.n = 0 THEN l.text ELSE coalesce(t, '') END AS text
FROM l JOIN g USING (doc_id)
"""
