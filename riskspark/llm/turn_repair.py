"""Conversation structure repair: Wagner-Fischer alignment of turns to an alternating grammar.

A conversation's role initials shall read ``(s?(ua)+)?``. Turns are kept, given another role,
deleted, or empty ones are inserted, each at its price, so a repair is an alignment of the turns
with one string of the grammar. ``cheapest`` aligns them with the string of each feasible length, those
that can be cheapest first; the cost of the best so far bounds the lengths that are tried and (Ukkonen)
the diagonals that are filled. Ties go to the backtraced audit that is least in ASCII.

A conversation is one stream of rows in the order of its turns through one task, since its repaired
text has one hash. Up to ``BLOCK`` rows are aligned at once. A longer one is aligned block by block, from
each state of the grammar to each (nothing written, after s, after u, after a): prices add up and audits
follow each other, so the cheapest of all is made of cheapest parts, and memory holds one block
and the audit so far, whatever the conversation's length.

Defined cases: a null role or text is one space (such a text is blank); a null id or turn is one space in the
damage's checksum, and null ids are one conversation; null turns come first; rows of equal turn go by
role, then text; repeated rows are duplicates; a conversation without rows after damage has zeros, an empty
audit and the hash of the empty string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
INF = 1 << 40
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_ROLE = {"u": "user", "a": "assistant"}


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): the rows after damage by crc32 of ``conv_id:turn``; of a
    dropped row only its conv_id stays, with ``there`` false."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
                        text.alias("text"), (kind != 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    rows = rows.select("conv_id", "turn", "role", "text", "there", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")
    return rows.select("conv_id", *[F.when(F.col("there"), F.col(c)).alias(c) for c in ("turn", "role", "text")], "there")


# --- alignment ----------------------------------------------------------------------------------

def _targets(state: int, length: int) -> list[tuple[str, int]]:
    """(string, state after it) of ``length`` letters that the grammar can write from ``state``."""
    if not length:
        return [("", state)]
    turn = "au" if state == AFTER_U else "ua"
    plain = (turn * length)[:length]
    out = [(plain, AFTER_U if plain[-1] == "u" else AFTER_A)]
    if state == START:
        rest = plain[:length - 1]
        out.append(("s" + rest, AFTER_S if not rest else AFTER_U if rest[-1] == "u" else AFTER_A))
    return out


#: what it costs that a turn (its initial; in capitals where it is truncated; x: it must go) becomes a letter
_BECOMES = {(f, t): INF if f == "x" or t == "s" and f.lower() != "s" else (f.lower() != t) * REROLE + f.isupper() * TRUNCATED for f in "xsuaoSUAO" for t in "sua"}


def _shift(d: int) -> int:
    return INSERT * d if d > 0 else -DELETE * d


def align(turns: str, target: str, bound: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest alignment, the audit least in ASCII, if it costs at most ``bound``.

    ``togo[i][j]`` is the price of the turns from ``i`` and the letters from ``j`` on, filled on those diagonals
    alone that a path within the bound can touch."""
    n, m = len(turns), len(target)
    band = [d for d in range(-n, m + 1) if _shift(d) + _shift(m - n - d) <= bound]
    if not band:
        return None
    low, high = band[0], band[-1]
    togo = [[INF] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        here, below = togo[i], togo[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                here[j] = 0
                continue
            best = DELETE + below[j] if i < n else INF
            if j < m:
                if target[j] != "s":
                    best = min(best, INSERT + here[j + 1])
                if i < n:
                    best = min(best, _BECOMES[turns[i], target[j]] + below[j + 1])
            here[j] = best
    cost = togo[0][0]
    if cost > bound or cost >= INF:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:  # D, I, K, R: the first that stays cheapest
        left = togo[i][j]
        if i < n and DELETE + togo[i + 1][j] == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and INSERT + togo[i][j + 1] == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=20_000)
def cheapest(turns: str, state: int, ends: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """For each state of ``ends`` that can be reached: the (cost, audit) of the best string that leads there."""
    gone = turns.count("x")
    stay = len(turns) - gone
    least = lambda length: DELETE * gone + _shift(length - stay)
    # to delete all and insert two reaches what can be reached, so longer strings than these are never cheapest
    longest = stay + (DELETE * len(turns) + 2 * INSERT - DELETE * gone) // INSERT
    best: dict[int, tuple[int, str]] = {}
    for length in sorted(range(longest + 1), key=least):
        for target, end in _targets(state, length):
            if end not in ends:
                continue
            bound = best[end][0] if end in best else INF - 1
            found = align(turns, target, bound) if least(length) <= bound else None
            if found and (end not in best or found < best[end]):
                best[end] = found
    return best


def written(turns: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) for each letter of the audit; a deleted turn is given as it was."""
    i = 0
    for edit in audit:
        if edit == "D":
            yield edit, *turns[i]
            i += 1
            continue
        role, text = ("", "") if edit == "I" else turns[i]
        i += edit != "I"
        letter = role[:1] if edit == "K" else "a" if state == AFTER_U else "u"
        state = AFTER_S if letter == "s" else AFTER_U if letter == "u" else AFTER_A
        yield edit, role if edit == "K" else _ROLE[letter], text


class Conversation:
    """What is known of one conversation while its rows come by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.turns: list[tuple[str, str]] = []
        self.marks: list[str] = []
        self.done: list[str] = []  # audit letters that all ways share
        self.ways = {START: (0, "", hashlib.sha256(), False)}  # state: cost, audit after `done`, hash, whether a line was written

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if len(self.turns) == BLOCK:
            self._close(tuple(range(4)))
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        end = text.rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if again else "truncated" if end not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        mark = "x" if fault in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.marks.append(mark.upper() if fault == "truncated" else mark)
        self.turns.append((role, text))

    def _close(self, ends: tuple[int, ...]) -> None:
        """Aligns the block and goes on with the cheapest way into each of ``ends``."""
        best = {}
        for state, (cost, audit, _, _) in self.ways.items():
            for end, (more, letters) in cheapest("".join(self.marks), state, ends).items():
                best[end] = min(best.get(end, (INF,)), (cost + more, audit + letters, state, letters))
        ways = {}
        for end, (cost, audit, state, letters) in best.items():
            sha, any_line = self.ways[state][2].copy(), self.ways[state][3]
            for edit, role, text in written(self.turns, letters, state):
                if edit != "D":
                    sha.update(f"{chr(10) * any_line}{role}:{text}".encode())
                    any_line = True
            ways[end] = (cost, audit, sha, any_line)
        shared = os.path.commonprefix([w[1] for w in ways.values()])
        self.done.append(shared)
        self.ways = {end: (cost, audit[len(shared):], sha, line) for end, (cost, audit, sha, line) in ways.items()}
        self.turns, self.marks = [], []

    def row(self) -> dict:
        self._close((START, AFTER_A))
        cost, audit, sha, _ = min(self.ways.values(), key=lambda w: w[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost,
                "audit": "".join(self.done) + audit, "repaired_sha256": sha.hexdigest()}


def _audit(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, turn, role, text, there, again in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv_id != conv_id:
                    if now:
                        out.append(now.row())
                    now = Conversation(conv_id)
                if there:
                    now.add(turn, role, text, again)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            out.append(now.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


_ORDER = ["turn", "role", "text"]  # ascending, nulls first; of equal rows the repeats come last


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, there): its faults and its cheapest repair."""
    from pyspark.sql.pandas.types import to_arrow_schema

    same = Window.partitionBy("conv_id", "role", "text", "there").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = st.StructType([rows.schema["conv_id"], *[st.StructField(c, st.LongType()) for c in longs],
                            st.StructField("audit", st.StringType()), st.StructField("repaired_sha256", st.StringType())])
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv_id", "turn", "role", "text", "there", "again").repartition(tasks, "conv_id")
    return rows.sortWithinPartitions("conv_id", *_ORDER, "again").mapInArrow(_audit(to_arrow_schema(schema)), schema)


def _apply(schema: pa.Schema):
    """Rows come by conversation, its audit before its turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, at, state, line = [], "", 0, START, 0

        def step(conv_id, turns):
            """Writes the edits up to and with that of the turn, or those that are left."""
            nonlocal at, state, line
            stop = at
            while stop < len(audit) and audit[stop] == "I":
                stop += 1
            stop += len(turns)
            for edit, role, text in written(turns, audit[at:stop], state):
                out.append({"conv_id": conv_id, "line": line, "edit": edit, "role": role, "text": text})
                line += 1
                if edit != "D":
                    state = {"s": AFTER_S, "u": AFTER_U}.get(role[:1], AFTER_A)
            at = stop

        current = None
        for batch in batches:
            for conv_id, letters, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if letters is not None:
                    if current is not None:
                        step(current[0], [])
                    current, audit, at, state, line = (conv_id,), letters, 0, START, 0
                else:
                    step(conv_id, [(role, text)])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if current is not None:
            step(current[0], [])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, line, edit, role, text): every turn of ``rows`` with the edit that ``found`` (see ``audits``)
    gives it and the inserted ones, in order; deleted turns are listed with edit D."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = st.StructType([rows.schema["conv_id"], st.StructField("line", st.LongType()),
                            *[st.StructField(c, st.StringType()) for c in ("edit", "role", "text")]])
    void = F.lit(None).cast("string")
    both = (found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), "audit", void.alias("role"), void.alias("text"))
            .union(rows.filter("there").select("conv_id", F.lit(1), "turn", void, "role", "text")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (both.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)
            .select("conv_id", "audit", "role", "text").mapInArrow(_apply(to_arrow_schema(schema)), schema))


#: an automaton over the rows instead of alignments: four states, one or two inserted turns before a row or the end
SQL = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
o AS (SELECT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '') AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(unicode(ch) AS BIGINT)),
                 lambda s, x: xor(step[xor(s, x) % 256 + 1], s >> 8), 4294967295), 4294967295) % 20 AS kind FROM conversations, k),
d AS (SELECT id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE kind <> 0),
e AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS f, lag(left(role, 1)) OVER w AS g, 
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d WINDOW w AS (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy)),
x AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut
      FROM (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 AS again FROM e)),
p(q, r, c, a, l) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
                     (3, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
v(q, r, t) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
z AS (SELECT id, 0 AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT id FROM o)
      UNION ALL
      SELECT id, i, q, best[1], best[2], lines FROM (
        SELECT id, i, q, min(row(cost, audit)) AS best, arg_min(lines, row(cost, audit)) AS lines FROM (
          SELECT z.id, x.i, p.r AS q, cost + p.c + 2 AS cost, audit || p.a || 'D' AS audit, list_concat(lines, p.l) AS lines FROM z JOIN x ON x.id = z.id AND x.i = z.i + 1 JOIN p ON p.q = z.q
          UNION ALL
          SELECT z.id, x.i, v.r, cost + p.c + CASE WHEN x.f = v.t THEN 0 ELSE 1 END + CASE WHEN x.cut THEN 5 ELSE 0 END, audit || p.a || CASE WHEN x.f = v.t THEN 'K' ELSE 'R' END,
                 list_concat(lines, list_concat(p.l, [CASE WHEN x.f = v.t THEN x.role WHEN v.t = 'u' THEN 'user' ELSE 'assistant' END || ':' || x.text]))
          FROM z JOIN x ON x.id = z.id AND x.i = z.i + 1 JOIN p ON p.q = z.q JOIN v ON v.q = p.r WHERE NOT x.blank AND NOT x.dup AND (x.f = v.t OR v.t <> 's'))
        GROUP BY id, i, q)),
n AS (SELECT id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
             count(*) FILTER (i > 1 AND g || f NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY id),
y AS (SELECT z.id, min(row(cost + p.c, audit || p.a)) AS best, arg_min(list_concat(lines, p.l), row(cost + p.c, audit || p.a)) AS lines
      FROM z LEFT JOIN n USING (id) JOIN p ON p.q = z.q WHERE z.i = coalesce(n.n, 0) AND p.r IN (0, 3) GROUP BY z.id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(y.best[1] AS BIGINT) AS cost, y.best[2] AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, id FROM o) c JOIN y USING (id) LEFT JOIN n USING (id)
"""


def query(turns: DataFrame) -> DataFrame:
    return audits(damaged(turns))
