"""Spelling variant grouping: k-d trees over letter-count vectors.

A word's vector counts its letters (``a``-``z`` each, the accented ones in ``SHARED`` counters). One
inserted or deleted letter changes one counter by one, a replaced one lowers one and raises one, so
near words lie within L1 distance 2. Vectors are kept in unary code (bit "at least t of letter d"),
so a split plane of the tree is one bit, a box is the pair (bits that all have, bits that any has),
and the distance to a box or a point is a count of bits. Counters and levels beyond the code's
``BITS`` are left out, which can only make distances smaller: the letters' order decides at the end.

Words of one length are one tree. Its upper levels are fitted on at most ``SAMPLE`` words of all lengths (chosen by hash) and
cut the space into cells of about ``CELL`` words; every word is put into its cell, and sent as a
query to each cell, of its own and the next length, whose box it can reach. A cell grows the lower levels over
all its words, searches its queries in batches, and compares the letters of what lies near enough.

Defined cases: null and empty texts have no words; a null doc_id stands as an empty string before
the colon; repeated rows count again; words of any length are kept whole; an empty table, or one
without a frequent word, gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import id_text, keep

MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
SAMPLE, CELL, LEAF = 200_000, 16_384, 64
#: distinct words that a task holds before it hands on their counts
HELD = 400_000
SHARED, BITS = 14, 128

_STEP = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _STEP[_i] = _c
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: counter of each code point below 256
_SLOT = np.array([26 + i % SHARED for i in range(256)], np.int64)
_SLOT[97:123] = np.arange(26)
#: (counter, level) of each bit: all counters once, the letters up to four times, some shared ones twice
_PLACES = [(d, 1) for d in range(26 + SHARED)] + [(d, t) for t in (2, 3, 4) for d in range(26)]
_PLACES += [(26 + d, 2) for d in range(BITS - len(_PLACES))]
_DIM = np.array([d for d, _ in _PLACES])
_LEVEL = np.array([t for _, t in _PLACES])


# --- counting -----------------------------------------------------------------------------------

def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the runs one after the other, each run's first byte and the end, each run's row)."""
    letter = _LETTER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF are 0xC3 and one byte more
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    place = np.cumsum(letter)
    first = np.append(place[start] - 1, place[-1] if len(place) else 0)
    return _LOW[data[letter]], first, np.searchsorted(off, start, "right") - 1


def _crc(prefix: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each span of ``data`` after a text whose crc32 is ``prefix``."""
    state = prefix.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    left = np.diff(first)
    order = np.argsort(-left, kind="stable")
    state, at, left = state[order], first[:-1][order], left[order]
    k = 0
    while len(left) and left[0] > k:
        n = len(left) - int(np.searchsorted(left[::-1], k, "right"))  # those of more than k bytes
        s = state[:n]
        state[:n] = _STEP[(s ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        k += 1
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def _damaged_runs(ids: list, texts: pa.Array) -> Iterator[pa.Array]:
    """Lower-cased runs of a batch after the deletions, those that are long enough."""
    for a, b, data, off in T.slices(texts):
        if not len(data):
            continue
        low, first, row = _runs(data, off)
        if not len(row):
            continue
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[a:b]], np.uint32)
        follow = (low & 0xC0) == 0x80
        points = np.diff(first) - np.add.reduceat(follow, first[:-1]).astype(np.int64)
        long = np.flatnonzero(points >= MIN_LENGTH)
        ends = first[1:]
        size = ends[long] - first[long]
        spans = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(first[long] - spans[:-1], size) + np.arange(spans[-1])
        low, row, points = low[take], row[long], points[long]
        h = _crc(heads[row], low, spans).astype(np.int64)
        cut = np.flatnonzero(h % EVERY == 0)
        keep_byte = np.ones(len(low), bool)
        whole = np.ones(len(row), bool)
        for i in cut.tolist():
            at = np.flatnonzero((low[spans[i]:spans[i + 1]] & 0xC0) != 0x80)
            p = int(h[i] % points[i])
            end = at[p + 1] if p + 1 < len(at) else spans[i + 1] - spans[i]
            keep_byte[spans[i] + at[p]:spans[i] + end] = False
            whole[i] = points[i] > MIN_LENGTH
        ends = np.concatenate([[0], np.cumsum(keep_byte)])[spans]
        out = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[keep_byte])])
        yield out.filter(pa.array(whole)) if len(cut) else out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task, summed before rows leave it."""
    parts, held = [], 0

    def summed():
        t = pa.table({"word": pa.concat_arrays([p.field(0) for p in parts]), "n": pa.concat_arrays([p.field(1) for p in parts])})
        return t.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    for batch in batches:
        for words in _damaged_runs(batch.column(0).to_pylist(), batch.column(1)):
            parts.append(pc.value_counts(words))
            held += len(parts[-1])
            if held > 2 * HELD:
                t = summed()
                if t.num_rows > HELD:
                    yield from t.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(50_000)
                    parts, held = [], 0
                else:
                    parts = [pa.StructArray.from_arrays([t["word"].combine_chunks(), t["n"].combine_chunks()], ["values", "counts"])]
                    held = t.num_rows
    if parts:
        yield from summed().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(50_000)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` letters that occur at least ``MIN_COUNT`` times."""
    counts = id_text(docs).mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# --- vectors and trees --------------------------------------------------------------------------

def codes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(words, 2) unary letter-count codes of the Latin-1 words ``data[first[i]:first[i + 1]]``."""
    n, dims = len(first) - 1, 26 + SHARED
    at = np.repeat(np.arange(n) * dims, np.diff(first)) + _SLOT[data]
    count = np.bincount(at, minlength=n * dims).reshape(n, dims)
    bits = np.ascontiguousarray(count[:, _DIM] >= _LEVEL)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n, 2)


def _bit(code: np.ndarray, b: int) -> np.ndarray:
    return (code[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) != 0


def _mask(which: np.ndarray) -> np.ndarray:
    return np.packbits(which, bitorder="little").view(np.uint64)


@dataclass
class Node:
    """Box of a subtree (``every``: bits that all its words have, ``some``: that any may have), its
    plane and halves, or the rows or cell of a leaf."""

    every: np.ndarray
    some: np.ndarray
    plane: int = -1
    without: Node | None = None
    having: Node | None = None
    leaf: object = None


def grow(code: np.ndarray, leaf: int, tight: bool, number: Iterator[int] | None = None) -> Node:
    """K-d tree; each plane is the bit that halves the words best. ``tight`` boxes hold the given
    words only; the others hold every word that the planes let through."""
    full = np.ones(BITS, bool)
    root = Node(_mask(~full), _mask(full))
    todo = [(root, np.arange(len(code)), ~full, full)]
    while todo:
        node, rows, every, some = todo.pop()
        own = code[rows]
        if tight and len(rows):
            node.every, node.some = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        bits = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little") if len(rows) > leaf else None
        share = bits.mean(axis=0, dtype=np.float64) if bits is not None else None
        if share is None or not ((share > 0) & (share < 1)).any():
            node.leaf = next(number) if number else rows
            continue
        b = int(np.argmin(np.abs(share - 0.5)))
        node.plane = b
        same = _DIM[b] == _DIM
        more, less = every | (same & (_LEVEL <= _LEVEL[b])), some & ~(same & (_LEVEL >= _LEVEL[b]))
        node.without, node.having = Node(_mask(every), _mask(less)), Node(_mask(more), _mask(some))
        has = bits[:, b] != 0
        todo += [(node.without, rows[~has], every, less), (node.having, rows[has], more, some)]
    return root


def reach(root: Node, code: np.ndarray, up: int, down: int) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, rows of ``code``): queries that get into the leaf's box by adding at most ``up`` and
    taking away at most ``down`` letters."""
    todo = [(root, np.arange(len(code)))]
    while todo:
        node, rows = todo.pop()
        own = code[rows]
        rows = rows[(np.bitwise_count(node.every & ~own).sum(axis=1) <= up) & (np.bitwise_count(own & ~node.some).sum(axis=1) <= down)]
        if not len(rows):
            continue
        if node.plane < 0:
            yield node.leaf, rows
        else:
            todo += [(node.without, rows), (node.having, rows)]


def home(root: Node, code: np.ndarray) -> np.ndarray:
    """Leaf number of each word."""
    out = np.zeros(len(code), np.int64)
    todo = [(root, np.arange(len(code)))]
    while todo:
        node, rows = todo.pop()
        if node.plane < 0:
            out[rows] = node.leaf
        elif len(rows):
            has = _bit(code[rows], node.plane)
            todo += [(node.without, rows[~has]), (node.having, rows[has])]
    return out


def upper_trees(words: DataFrame, total: int, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Node]:
    """Tree of cells per word length, from a bounded sample; cells are numbered through all lengths."""
    share = min(1.0, sample / max(total, 1))
    part = words if share == 1 else words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = [r.word for r in part.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).toLocalIterator()]
    lengths = [r.length for r in words.select(F.char_length("word").alias("length")).distinct().collect()]
    by: dict[int, list[str]] = {n: [] for n in lengths}
    for w in drawn:
        by[len(w)].append(w)
    size = max(32, int(cell * len(drawn) / max(total, 1)))
    number = iter(range(1 << 62))
    out = {}
    for n in sorted(by):
        first = np.arange(len(by[n]) + 1) * n
        data = np.frombuffer("".join(by[n]).encode("latin-1"), np.uint8)
        out[n] = grow(codes(data, first), size, False, number)
    return out


_HOME, _SAME, _LONGER = 0, 1, 2


def _send(trees: dict[int, Node]):
    """Rows (cell, kind, word, n): each word to its cell, and as a query to the cells it can reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            raw = pa.array([w.encode("latin-1") for w in words], pa.binary())
            data, off = T.buffers(raw)
            code = codes(data, off)
            for length in np.unique(np.diff(off)).tolist():
                mine = np.flatnonzero(np.diff(off) == length)
                own = code[mine]
                found = [(home(trees[length], own), mine, _HOME)]
                for tree, kind, down in ((trees[length], _SAME, 1), (trees.get(length + 1), _LONGER, 0)):
                    if tree:
                        found += [(np.full(len(rows), leaf, np.int64), mine[rows], kind) for leaf, rows in reach(tree, own, 1, down)]
                for cell, rows, kind in found:
                    yield pa.record_batch({"cell": pa.array(cell), "kind": pa.array(np.full(len(rows), kind, np.int8)), "word": raw.take(pa.array(rows)), "n": pa.array(n[rows])})
    return run


# --- search in a cell ---------------------------------------------------------------------------

def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` has one letter more than ``a``: what they share at the front and at the back covers ``a``."""
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


class Cell:
    """Words of one cell (all of one length) with the lower levels of their tree."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)  # Latin-1 bytes are in code-point order
        self.words, self.n = [words[i] for i in order], n[order]
        self.length = len(words[0])
        self.letters = np.frombuffer(b"".join(self.words), np.uint8).reshape(len(words), self.length)
        self.code = codes(self.letters.ravel(), np.arange(len(words) + 1) * self.length)
        self.root = grow(self.code, LEAF, True)

    def pairs(self, data: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) rows that are near; ``data`` is a matrix of the queries' letters."""
        code = codes(data.ravel(), np.arange(len(data) + 1) * data.shape[1])
        most, test = (2, _one_replaced) if kind == _SAME else (1, _one_inserted)
        found = []
        for leaf, rows in reach(self.root, code, 1, 1 if kind == _SAME else 0):
            for at in range(0, len(rows), 1 << 15):
                q = rows[at:at + (1 << 15)]
                apart = np.bitwise_count(code[q, None, 0] ^ self.code[None, leaf, 0])
                apart += np.bitwise_count(code[q, None, 1] ^ self.code[None, leaf, 1])
                i, j = np.nonzero(apart <= most)
                i, j = q[i], leaf[j]
                step = max(1, (1 << 22) // self.length)
                for k in range(0, len(i), step):
                    near = test(data[i[k:k + step]], self.letters[j[k:k + step]])
                    found.append((i[k:k + step][near], j[k:k + step][near]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rank(words: list[bytes]) -> np.ndarray:
    """Each word's place in code-point order."""
    out = np.zeros(len(words), np.int64)
    out[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return out


def _best(of: np.ndarray, near: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct ``of``: count of near words and the row of the commonest (the first on ties)."""
    order = np.lexsort((rank[near], -n[near], of))
    of, near = of[order], near[order]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[new], np.diff(np.append(new, len(of))), near[new]


def _rows(words: list[bytes], of: np.ndarray, count: np.ndarray, near: np.ndarray, near_words: list[bytes], near_n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array([words[i].decode("latin-1") for i in of.tolist()], pa.string()), "n_near": pa.array(count.astype(np.int64)),
                            "near": pa.array([near_words[i].decode("latin-1") for i in near.tolist()], pa.string()), "near_n": pa.array(near_n[near])})


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, the cell's own words before its queries; a batch of queries is searched at a time."""
    current, own, own_n, cell = None, [], [], None
    for batch in batches:
        cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        words, n = batch.column(2).to_pylist(), batch.column(3).to_numpy()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if cells[a] != current:
                current, own, own_n, cell = cells[a], [], [], None
            if kinds[a] == _HOME:
                own += words[a:b]
                own_n.append(n[a:b])
                continue
            if not own:
                continue
            cell = cell or Cell(own, np.concatenate(own_n))
            asked, asked_n = words[a:b], n[a:b]
            q, w = cell.pairs(np.frombuffer(b"".join(asked), np.uint8).reshape(len(asked), -1), int(kinds[a]))
            if len(q):
                yield _rows(asked, *_best(q, w, cell.n, np.arange(len(cell.n))), cell.words, cell.n)
                if kinds[a] == _LONGER:
                    yield _rows(cell.words, *_best(w, q, asked_n, _rank(asked)), asked, asked_n)


def near_words(words: DataFrame, total: int, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, near, near_n): words with near ones, how many, and the commonest of them."""
    trees = upper_trees(words, total, sample, cell)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = words.select("word", "n").mapInArrow(_send(trees), "cell long, kind byte, word binary, n long")
    found = (sent.repartition(tasks, "cell").sortWithinPartitions("cell", "kind")
             .mapInArrow(_search, "word string, n_near long, near string, near_n long"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n")))


# --- forms and roots ----------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the (word, form) rows. A form occurs at least ``RATIO`` times as often as its
    word, so chains have no circle and about log(largest n) links; each round doubles what is followed."""
    links = keep(forms.select("word", F.col("form").alias("root")), "spelling")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = keep(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling")
        if not links.filter("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """One row per word: its form, root and counts (see the module's text)."""
    words = keep(vocabulary(docs), "spelling")
    total = words.count()
    near = near_words(words, total, sample, cell)
    out = keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("near_n") >= RATIO * F.col("n"), F.col(c)).alias(a) for c, a in (("near", "form"), ("near_n", "form_n"))]), "spelling")
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 in SQL: a table of 256 steps, then one step a byte; runs hold code points below 256 only
SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
      WHERE length(run) >= 6 GROUP BY doc_id, run),
b AS (SELECT r.*, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: unicode(ch)) AS points FROM r),
h AS (SELECT run, c, xor(list_reduce(flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [CAST(p AS BIGINT)] ELSE [192 + (p >> 6), 128 + (p & 63)] END)),
             lambda s, x: xor(step[xor(s, x) % 256 + 1], s >> 8), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word
      UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word)),
m AS (SELECT word, count(*) AS n_near, min(row(-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n
      FROM w LEFT JOIN m USING (word)),
c AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL
      UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, k) AS root FROM c GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN e USING (word)
"""
