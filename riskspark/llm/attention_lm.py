"""Causal self-attention language model over subword ids, in numpy, for scoring whole texts.

Words (A-Z lower-cased) are given to the tokenizer as " word"; a word is its ids and an end-of-word
event, a text its words and one end mark. The model predicts each id as a mixture: ``TOPICS``
distributions over ids (one set for first ids of words, one for later ids) and the share that the id
has in the corpus after the ids before it in its word, and after the one id before it. The mixture weights come
from one causal attention layer over the ids before: an id's input vector is what it says about each topic,
queries, keys, values, a distance bias and the output layer are learned. They depend on what stands before
alone, so the probabilities of all ids (and, where a word could begin, of the end mark) add up to 1.

What is learned from the training rows, all of them: word counts (and from these the prefix counts
and the unigram base), topic counts of every id, and the attention weights, fitted by Adam on
all windows of every training text in each task and averaged over tasks. A text's topic is its cluster among all training
texts, by k-means over how its words spread over ``BUCKETS`` (square roots of shares, so distances are Hellinger's); it is
found while the texts are cut into parts, and no text is left out.

Scoring cuts a text's ids into windows of ``CONTEXT`` ids that are only attended to and ``STEP`` ids
that are scored, so windows overlap and each id is scored once, in batches under one causal mask.

Every count of words, prefixes and pairs is kept. Sent to tasks: words, prefixes (with their ends) and
pairs of a share of at least ``HEAVY`` of all tokens (at most 1/HEAVY of them, for prefixes and pairs for
each place in a word), topic tables of the fixed vocabulary. Texts are cut into parts of about ``PART`` bytes. The rarer
counts are gathered by word, joined with the distinct words of each part, and written with the words' ids as one list a part, which
a task reads when it comes to the part's texts; texts are neither moved nor copied for it, and each distinct word of the table is tokenized once. The fit leaves each word's
own occurrence out of the counts; otherwise a prefix seen once would always be followed by what it predicts.

Defined cases: null and empty texts are the end mark alone; rows without doc_id are held out;
repeated rows are scored each; an empty table gives an empty result; without training rows all
distributions are uniform and the base is 0; other columns are not read.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as T
from riskspark.llm.common import arrow_fs, give_back, id_text, in_part, keep, list_array
from riskspark.session import scratch_path

END, VOCABULARY = 50257, 50258
TOPICS, WIDTH, CONTEXT, STEP = 8, 8, 16, 16
SPAN = CONTEXT + STEP
INPUT = TOPICS + 2  # topic evidence, first id of a word, constant
BUCKETS, ROUNDS, EPOCHS, RATE, BATCH = 64, 20, 1, 0.02, 64
HEAVY, MAX_IDS, MEMO, LOGIT = 2.0**-20, 6, 1_000_000, 30
#: bytes of text in a part; distinct words that a task holds before it hands on their counts
PART, HELD = 32 << 20, 400_000
#: windows that are scored together
TOGETHER = 256
#: path of the ranks file (None: the public one)
TOKENIZER = None
SHAPES = {"q": (INPUT, WIDTH), "k": (INPUT, WIDTH), "v": (INPUT, TOPICS), "far": (SPAN,), "out": (TOPICS + INPUT + 2, TOPICS + 2)}
_ROOT = T.U64(0x1234567)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def next_key(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of prefixes that are one id longer."""
    return T.mix((key ^ (ids.astype(np.uint64) + T.U64(1))) * T.U64(0x9E3779B97F4A7C15))


def pair_key(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return T.mix((before.astype(np.uint64) << T.U64(20)) + ids.astype(np.uint64) + T.U64(0xA11CE << 40))


def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word); a word that is no text of its own gets the ids of its bytes all the same.
    Words are tokenized together as one text; the ids' lengths in bytes tell them apart, for no id goes on past a space."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    encoder, size = _encoder()
    text = " " + " ".join(words)
    ids, raw = np.array(encoder.encode_ordinary(text), np.int64), np.frombuffer(text.encode(), np.uint8)
    start, upto = np.flatnonzero(raw == 32), np.cumsum(size[ids])
    stop = np.append(start[1:], len(raw))
    last = np.searchsorted(upto, stop)
    if len(start) == len(words) and last[-1] == len(ids) - 1 and (upto[last] == stop).all():
        return ids, np.diff(last, prepend=-1)
    found = [encoder.encode_ordinary(" " + w) for w in words]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for x in found for i in x), np.int64, int(n.sum())), n


def _encoder():
    """The tokenizer and each id's length in bytes."""
    if not _open:
        import base64

        import public_tokenizers
        import tiktoken

        with open(TOKENIZER or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(b) for b in ranks]
        _open.append((tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size))
    return _open[0]


_open: list = []


class Counts:
    """What the frequent counts say: of prefixes and their ends, of pairs of ids inside words, of ids followed and of words ending."""

    def __init__(self, prefixes: Lookup, pairs: Lookup, follow: np.ndarray, ends: np.ndarray) -> None:
        self.prefixes, self.pairs, self.follow, self.ends = prefixes, pairs, follow, ends
        self.id = (len(prefixes.keys), len(pairs.keys), float(follow.sum()), float(ends.sum()))


class Lookup:
    """Values (a row, or several rows) of sorted 64-bit keys; 0 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[..., order]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether the key is there)."""
        if not len(self.keys):
            return np.zeros((*self.values.shape[:-1], len(wanted))), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        here = self.keys[at] == wanted
        return np.where(here, self.values[..., at], 0), here

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        return self.find(wanted)[0]


def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of ``n`` values from each ``begin`` on, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class PartWords:
    """The distinct words of a part: their ids and what the frequent counts leave out of them (packed lists; none are read for ids alone)."""

    def __init__(self, h: np.ndarray | None = None, ids: pa.Array | None = None, q: pa.Array | None = None) -> None:
        self.keys = np.zeros(0, np.uint64)
        if h is not None and len(h):
            order = np.argsort(h.view(np.uint64))
            self.keys = h.view(np.uint64)[order]
            raw, off = T.buffers(ids)
            self.ids, self.begin, self.n = raw.view(np.uint16), off[order] // 2, np.diff(off)[order] // 2
            if q is not None:
                times, self.packed = q.value_lengths().to_numpy(zero_copy_only=False), q.flatten().to_numpy(zero_copy_only=False)
                self.first, self.times = (np.cumsum(times) - times)[order], times[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, whether they are here)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def ids_of(self, w: T.Words, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words by their hashes; ``at``: where a slice has them. Words that are not here are tokenized."""
        place, here = self.find(keys)
        if here.all():
            n = self.n[place] if len(place) else place
            return (self.ids[spans(self.begin[place], n)] if len(place) else place).astype(np.int64), n
        raw, gap, n = w.data.tobytes().translate(_LOWER), at[~here], np.zeros(len(keys), np.int64)
        more, n[~here] = word_ids([raw[i:j].decode("utf-8", "replace") for i, j in zip(w.start[gap].tolist(), w.end[gap].tolist(), strict=True)])
        if here.any():
            n[here] = self.n[place[here]]
        ids, begin = np.zeros(int(n.sum()), np.int64), np.cumsum(n) - n
        ids[spans(begin[~here], n[~here])] = more
        if here.any():
            ids[spans(begin[here], n[here])] = self.ids[spans(self.begin[place[here]], n[here])]
        return ids, n

    def rare(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words with ``n`` ids: (prefix count, ends, pair count) at each id, and the words' own counts."""
        each, own = np.zeros((3, int(n.sum()))), np.zeros(len(keys))
        place, here = self.find(keys)
        word = np.flatnonzero(here)
        if len(word):
            times = self.times[place[word]]
            where, c, e = unpacked(self.packed[spans(self.first[place[word]], times)])
            word = np.repeat(word, times)
            alone, pair = where < 0, where > MAX_IDS
            own[word[alone]] = c[alone]
            inside = np.where(pair, where - MAX_IDS, where)
            at = (np.cumsum(n) - n)[word] + inside
            pair &= inside < n[word]  # holds, but where two words have one hash
            prefix = ~alone & (where < MAX_IDS) & (inside < n[word])
            each[0, at[prefix]], each[1, at[prefix]], each[2, at[pair]] = c[prefix], e[prefix], c[pair]
        return each, own


class Parts:
    """The lists of words in a folder of the shared store; the last part's list is held."""

    def __init__(self, folder: str, counts: bool = True) -> None:
        self.folder, self.part, self.list, self.columns = folder, None, None, ["h", "ids", "q"][: 3 if counts else 2]

    def __call__(self, part: int) -> PartWords:
        if part != self.part:
            self.part, self.list = None, None  # the last list goes before the next one comes
            _memo[0] = Memo()
            fs, folder = arrow_fs(self.folder)
            found = fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/part={part}", allow_not_found=True))
            files = [f.path for f in found if f.path.endswith(".parquet")]
            tables = [pq.ParquetFile(fs.open_input_file(f)).read(self.columns).combine_chunks() for f in files]
            rows = pa.concat_tables(tables).combine_chunks() if tables else None
            one = lambda c: rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks()
            lists = [one(c) for c in self.columns] if rows is not None and rows.num_rows else None
            self.part, self.list = part, PartWords(lists[0].to_numpy(), *lists[1:]) if lists else PartWords()
            del rows, tables, lists
            give_back()
        return self.list

    def of(self, batches):
        """(batch, its part's list) of batches with a column ``part``, cut where the part changes."""
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else []
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if b > a:
                    yield batch.slice(a, b - a), self(int(part[a]))


#: A rare count in 64 bits: for pairs the sign, 31 bits of place and 32 of count; else 3 bits of place (7: the word itself), 30 of
#: count and 30 of ends (rare counts are below HEAVY of all tokens, so 30 bits do up to 2^50 tokens)
PACKED = f"if(place > {MAX_IDS}, shiftleft(place | 2147483648L, 32) | c, shiftleft(cast(place & 7 as bigint), 60) | shiftleft(c, 30) | e)"


def unpacked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, count, ends) of PACKED."""
    low = (v >> 60) & 7
    place = np.where(v < 0, (v >> 32) & 0x7FFFFFFF, np.where(low == 7, -1, low))
    return place, np.where(v < 0, v & 0xFFFFFFFF, (v >> 30) & 0x3FFFFFFF), np.where(v < 0, 0, v & 0x3FFFFFFF)


class Memo:
    """Ids of the words that this worker has met in a part and what ``shares`` gives of them for one set of counts (``of``), in flat arrays."""

    def __init__(self, of: tuple | None = None) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes; the words' numbers
        self.ids, self.n, self.of, self.parts = np.zeros(0, np.uint16), np.zeros(0, np.int64), of, None

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for words not met."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, parts: tuple) -> None:
        """New words; their hashes are sorted."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, len(self.n) + np.arange(len(n)))
        self.parts = [np.concatenate(x) for x in zip(self.parts, parts, strict=True)] if self.parts else list(parts)
        self.ids, self.n = np.concatenate([self.ids, ids.astype(np.uint16)]), np.concatenate([self.n, n])


_memo = [Memo()]


def shares(ids: np.ndarray, n: np.ndarray, c: Counts, rare: np.ndarray, less: int = 0) -> tuple[np.ndarray, ...]:
    """Of words' ids: each id's share after its prefix and after the id before (-1: unknown)
    and how often that prefix was seen (a logarithm), and per word log10 of its end events.
    ``rare``: the counts that ``c`` leaves out, at each id (see PartWords.rare); ``less``: occurrences of the word itself that do not count."""
    begin = np.cumsum(n) - n
    share, pair, log_end = np.full(len(ids), -1.0, np.float32), np.full(len(ids), -1.0, np.float32), np.zeros(len(n))
    seen = np.zeros(len(ids), np.float32)
    word = np.arange(len(n))
    key = np.full(len(n), _ROOT)
    count, stop = np.maximum(c.prefixes(key)[0] - less, 0), np.zeros(len(n))

    def either(often: Lookup, key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        got, here = often.find(key)
        gap = np.flatnonzero(~here)
        if len(gap):
            got[: len(rows), gap] = rows[:, at[gap]]
        return got

    for j in range(int(n.max()) if len(n) else 0):
        live = n[word] > j
        word, key, count, stop = word[live], key[live], count[live], stop[live]
        at = begin[word] + j
        rate = c.ends[ids[at]]
        if j < MAX_IDS:
            key = next_key(key, ids[at])
            longer, ended = either(c.prefixes, key, rare[:2])
            longer, ended = np.maximum(longer - less, 0), np.maximum(ended - less * (n[word] == j + 1), 0)
            share[at] = np.where(count > 0, longer / np.maximum(np.maximum(count - stop, longer), 1), -1)
            seen[at] = np.log1p(count) / 4
            count, stop = longer, ended
            rate = (stop + 2 * rate) / (count + 2)
        else:
            count = np.zeros(len(word))
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        log_end[word] += np.log10(np.where(j == n[word] - 1, rate, 1 - rate))
        if j:
            total = c.follow[ids[at - 1]] - less
            both = np.maximum(either(c.pairs, pair_key(ids[at - 1], ids[at]), rare[2:])[0] - less, 0)
            pair[at] = np.where(total > 0, both / np.maximum(total, 1), -1)
    return share, pair, seen, log_end


def word_parts(w: T.Words, c: Counts | None, words: PartWords, less: int = 0) -> dict:
    """Ids of a slice's words; with counts, also what ``shares`` gives and the words' own rare counts. Each distinct word is looked at once per part."""
    uniq, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    if c is None:
        ids, n = words.ids_of(w, uniq, at)
        count = n[inverse]
        return {"ids": ids[spans((np.cumsum(n) - n)[inverse], count)], "count": count}
    if len(_memo[0].keys) > MEMO or _memo[0].of != (*c.id, less):
        _memo[0] = Memo((*c.id, less))
    m = _memo[0]
    place = m.numbers(uniq)
    new = np.flatnonzero(place < 0)
    if len(new):
        ids, n = words.ids_of(w, uniq[new], at[new])
        place[new] = len(m.n) + np.arange(len(new))
        rare, own = words.rare(uniq[new], n)
        m.add(uniq[new], ids, n, (*shares(ids, n, c, rare, less), own))
    word = place[inverse]
    count = m.n[word]
    out = spans((np.cumsum(m.n) - m.n)[word], count)
    got = {"ids": m.ids[out].astype(np.int64), "count": count, "log_end": m.parts[3][word], "rare": m.parts[4][word]}
    return got | {name: x[out] for name, x in zip(("share", "pair", "seen"), m.parts, strict=False)}


def with_ends(w: T.Words, got: dict, words: float = 0) -> dict:
    """Streams of ids with each text's end mark: ids, first-of-word flags, shares, and where texts begin.

    ``words``: how many words the counts know. An end mark stands where a word could begin, so it has the mixture of a
    first id there: the share of words that begin with it is 0, and as many words were seen."""
    per_word = np.concatenate(([0], np.cumsum(got["count"])))
    first = per_word[w.first] + np.arange(len(w.first))  # one end mark for each text before
    total = int(first[-1])
    ends = first[1:] - 1
    inside = np.ones(total, bool)
    inside[ends] = False
    ids, start = np.full(total, END), np.ones(total, bool)
    ids[inside] = got["ids"]
    flag = np.zeros(len(got["ids"]), bool)
    flag[per_word[:-1][got["count"] > 0]] = True
    start[inside] = flag
    out = {"ids": ids, "start": start, "first": first}
    for name in ("share", "pair", "seen"):
        if name in got:
            end = {"seen": np.log1p(words) / 4, "share": 0 if words > 0 else -1, "pair": -1}[name]
            out[name] = np.full(total, end, np.float32)
            out[name][inside] = got[name]
    return out


def spread(w: T.Words, k: int) -> np.ndarray:
    """(k, BUCKETS) of a slice's k texts: 127 times the square root of the share of words in each bucket of their hashes."""
    bucket = (T.mix(w.hash) % T.U64(BUCKETS)).astype(np.int64)
    n = np.bincount(w.doc * BUCKETS + bucket, minlength=k * BUCKETS).reshape(k, BUCKETS)
    return np.rint(127 * np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1))).astype(np.int8)


def topic_centres(rows: DataFrame) -> np.ndarray:
    """Centres (at most TOPICS) of the spreads of all ``rows``; the other solver fails where there are fewer texts than centres."""
    vectors = rows.select(array_to_vector(F.col("spread").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=TOPICS, maxIter=ROUNDS, seed=9, solver="row").fit(vectors).clusterCenters())


def inputs(topics: np.ndarray) -> np.ndarray:
    """(2 * VOCABULARY + 1, INPUT): an id's topic evidence, inside and at the start of words; the last row stands before a text."""
    evidence = []
    for part in topics:
        mean = part.mean(axis=0)
        evidence.append(np.clip(np.log(part / mean), -4, 4).T)
    x = np.zeros((2 * VOCABULARY + 1, INPUT), np.float32)
    x[:VOCABULARY, :TOPICS], x[VOCABULARY:-1, :TOPICS] = evidence
    x[VOCABULARY:-1, TOPICS] = 1
    x[:, -1] = 1
    return x


def first_weights() -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    p = {n: rng.normal(0, 0.05, s).astype(np.float32) for n, s in SHAPES.items()}
    p["v"][:TOPICS] += np.eye(TOPICS, dtype=np.float32)
    p["out"][:TOPICS, :TOPICS] += 4 * np.eye(TOPICS, dtype=np.float32)
    p["out"][-2, TOPICS:] += (1.5, 0.5)  # beside the constant's place: the sure shares count more the more often their prefix was seen
    p["out"][TOPICS + INPUT - 1, TOPICS:] += (-1.0, 0.5)
    return p


_MASK = np.where(np.arange(SPAN)[None, :] <= np.arange(STEP)[:, None] + CONTEXT, 0.0, -1e9).astype(np.float32)
_BACK = np.clip(np.arange(STEP)[:, None] + CONTEXT - np.arange(SPAN)[None, :], 0, SPAN - 1)


def forward(p: dict, x: np.ndarray, valid: np.ndarray, now: np.ndarray, known: np.ndarray, like: np.ndarray):
    """n windows: x (n + 1, STEP, INPUT) inputs in blocks (a window is a block after the one before it; CONTEXT is STEP) and valid
    the windows that begin a text and see nothing before it, or x (n, SPAN, INPUT) with valid keys (n, SPAN);
    now (n, STEP, 2) how often the prefix was seen and whether a word begins, known prefixes, like (n, STEP, TOPICS + 2) each
    component's probability of the id. Logits are cut at LOGIT. Inside, features come first and places last, so that steps run
    over long rows. Returns p(id) and what backward needs."""
    n, shared = len(now), x.shape[1] == STEP
    once = np.zeros((INPUT, 1), np.float32)
    once[-1] = 1  # the constant input: a value row of ones sums the attention up
    y = np.concatenate([p["q"] / np.float32(np.sqrt(WIDTH)), p["k"], p["v"], once, p["out"][TOPICS:-2]], 1).T @ x.reshape(-1, INPUT).T
    w = np.lib.stride_tricks.as_strided(y, (n, len(y), SPAN), ((STEP if shared else SPAN) * y.itemsize, y.strides[0], y.itemsize), writeable=False)
    q, k, v, own = w[:, :WIDTH, CONTEXT:], w[:, WIDTH : 2 * WIDTH], w[:, 2 * WIDTH : 2 * WIDTH + TOPICS + 1], w[:, 2 * WIDTH + TOPICS + 1 :, CONTEXT:]
    s = q.transpose(0, 2, 1) @ k
    s += p["far"][_BACK] + _MASK
    if not np.sqrt(np.square(q).sum(axis=1).max() * np.square(k).sum(axis=1).max()) + p["far"].max() < LOGIT:  # no product is above that
        np.minimum(s, LOGIT, out=s)
    np.exp(s, out=s)
    if shared:
        s[valid, :, :CONTEXT] = 0
    else:
        s *= valid[:, None, :]
    c = np.empty((TOPICS + 1, n, STEP), s.dtype)
    np.matmul(v, s.transpose(0, 2, 1), out=c.transpose(1, 0, 2))
    total = np.maximum(c[TOPICS], np.float32(1e-30))
    c = (c[:TOPICS] / total).reshape(TOPICS, -1)
    now, like = _first(now), _first(like)
    z = p["out"][:TOPICS].T @ c
    z += p["out"][-2:].T @ now
    z += own.transpose(1, 0, 2).reshape(TOPICS + 2, -1)
    np.clip(z, -LOGIT, LOGIT, out=z)
    np.exp(z, out=z)  # topics share one weight, the two shares of the corpus have one each
    z[TOPICS:] *= _first(known)
    among, every = z[:TOPICS].sum(axis=0), 1 + z[TOPICS] + z[TOPICS + 1]
    each = z * like
    prob = (each[:TOPICS].sum(axis=0) / among + each[TOPICS] + each[TOPICS + 1]) / every
    return prob.reshape(n, STEP), (q, k, v, s, total, c, now, z, among, every)


def _first(a: np.ndarray) -> np.ndarray:
    """(features, windows * places) of (windows, places, features)."""
    return a.transpose(2, 0, 1).reshape(a.shape[2], -1)


def backward(p: dict, x, valid, like, prob, kept, scored) -> dict:
    q, k, v, s, total, c, now, z, among, every = kept
    n, shared, like, prob = len(s), x.shape[1] == STEP, _first(like), prob.reshape(-1)
    scale = (scored / np.float32(max(scored.sum(), 1))).astype(np.float32).reshape(-1)
    z[:TOPICS] /= among
    g = like / -np.maximum(prob, np.float32(1e-30))
    g += 1
    g *= z
    g *= scale / every
    g[:TOPICS] -= z[:TOPICS] * g[:TOPICS].sum(axis=0)
    dc = p["out"][:TOPICS] @ g
    around = (dc * c).sum(axis=0).reshape(n, STEP, 1)
    dc = dc.reshape(TOPICS, n, STEP).transpose(1, 0, 2)
    s /= total[..., None]
    ds = dc.transpose(0, 2, 1) @ v[:, :TOPICS]
    ds -= around
    ds *= s
    dq, d = np.empty((WIDTH, n, STEP), s.dtype), np.empty((WIDTH + TOPICS, n, SPAN), s.dtype)
    np.matmul(k, ds.transpose(0, 2, 1), out=dq.transpose(1, 0, 2))
    np.matmul(q, ds, out=d[:WIDTH].transpose(1, 0, 2))
    np.matmul(dc, s, out=d[WIDTH:].transpose(1, 0, 2))
    if shared:  # a block is one window's context and another's own ids
        both = np.zeros((WIDTH + TOPICS, n + 1, STEP), s.dtype)
        both[:, 1:] = d[..., CONTEXT:]
        both[:, :-1] += d[..., :CONTEXT]
        d = both
    here = (x[1:] if shared else x[:, CONTEXT:]).reshape(-1, INPUT)
    kv = (d.reshape(WIDTH + TOPICS, -1) @ x.reshape(-1, INPUT)).T
    return {"q": (dq.reshape(WIDTH, -1) @ here).T / np.float32(np.sqrt(WIDTH)), "k": kv[:, :WIDTH], "v": kv[:, WIDTH:],
            "far": np.bincount(_BACK.ravel(), weights=ds.sum(axis=0).ravel(), minlength=SPAN),
            "out": np.concatenate([c @ g.T, (g @ here).T, now @ g.T])}


class Model:
    """Topic tables (2, TOPICS, VOCABULARY), inside words and at their start; counts; attention weights."""

    together = TOGETHER

    def __init__(self, topics, counts: Counts, weights: dict | None = None) -> None:
        self.like = np.concatenate([topics[0].T, topics[1].T]).astype(np.float32, order="C")  # a row per id
        self.x, self.counts = inputs(topics), counts
        self.weights = weights or first_weights()

    def windows(self, s: dict):
        """Batches of windows over streams (see with_ends): positions scored and the arguments of forward."""
        code = s["ids"] + VOCABULARY * s["start"]
        before = np.concatenate(([2 * VOCABULARY], code[:-1]))  # an id's input is the one before
        before[s["first"][:-1]] = 2 * VOCABULARY
        each = np.stack([s["share"], s["pair"], s["seen"], s["start"]]).astype(np.float32)
        n = np.diff(s["first"])
        per = -(-n // STEP)
        doc = np.repeat(np.arange(len(n)), per)
        block = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP
        for a in range(0, len(doc), self.together):
            d, b = doc[a : a + self.together], block[a : a + self.together]
            place = (s["first"][d] + b)[:, None] + np.arange(STEP)
            scored = place < s["first"][d + 1][:, None]
            target = np.minimum(place, s["first"][d + 1][:, None] - 1).ravel()
            shape = (len(d), STEP, -1)
            last = before[s["first"][doc[a - 1]] + block[a - 1] + np.arange(STEP)] if a and b[0] else np.full(STEP, 2 * VOCABULARY)
            x = self.x.take(np.concatenate([last, before.take(target)]), axis=0).reshape(-1, STEP, INPUT)
            four = each.take(target, axis=1)
            like = np.empty((TOPICS + 2, len(target)), np.float32)
            like[:TOPICS] = self.like.take(code.take(target), axis=0).T
            np.maximum(four[:2], 0, out=like[TOPICS:])
            yield target.reshape(len(d), STEP), scored, (x, np.flatnonzero(b == 0), *(f.T.reshape(shape) for f in (four[2:], four[:2] >= 0, like)))

    def log10(self, s: dict) -> np.ndarray:
        """log10 probability of every id of the streams."""
        out = [forward(self.weights, *args)[0][scored] for _, scored, args in self.windows(s)]  # windows come in the streams' order
        return np.log10(np.maximum(np.concatenate(out), 1e-30).astype(float)) if out else np.zeros(0)


def _streams(texts: pa.Array, model: Model | None, words: PartWords | None = None, less: int = 0):
    """Slices of texts as streams of ids; ``words``: their part's; ``less``: see shares."""
    words = words or PartWords()
    for a, b, data, off in T.slices(texts, 2 * T.SLICE_BYTES):
        w = T.words(data, off)
        got = word_parts(w, model and model.counts, words, less)
        known = max(float(model.counts.prefixes(np.array([_ROOT]))[0, 0]) - less, 0) if model else 0
        yield a, b, w, got, with_ends(w, got, known)


def _counts(batches):
    """(word, count in rows that are not held out) of a task's words, summed before rows leave it."""
    parts, held = [], 0
    kind = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def summed():
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).cast(kind)

    for batch in batches:
        train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, off in T.slices(batch.column(0)):
            w = T.words(data, off)
            uniq, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            c = np.bincount(inverse, weights=train[a:b][w.doc], minlength=len(uniq)).astype(np.int64)
            size = w.end[at] - w.start[at]
            ends = np.concatenate(([0], np.cumsum(size)))
            low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)[np.repeat(w.start[at] - ends[:-1], size) + np.arange(ends[-1])]
            words = pa.Array.from_buffers(pa.large_string(), len(uniq), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low)])
            parts.append(pa.table({"word": words.cast(pa.string()), "c": c}))
            held += len(uniq)
            if held > 2 * HELD:
                parts = [summed()]
                held = parts[0].num_rows
                if held > HELD:
                    yield from parts[0].to_batches(50_000)
                    parts, held = [], 0
                give_back()
    if parts:
        yield from summed().combine_chunks().to_batches(50_000)
    parts.clear()
    give_back()


def _hashed(words: pa.Array) -> np.ndarray:
    data, off = T.buffers(words)
    return T.span_hash(data, off[:-1], off[1:])


def _listed(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of a column of ids in 16 bits each."""
    raw, off = T.buffers(ids)
    return raw.view(np.uint16).astype(np.int64), np.diff(off) // 2


#: kinds of rows in the table of counts by key
PREFIX_ROW, PAIR_ROW, ID_ROW, LAST_ROW = range(4)


def _inner_pairs(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in ids) of ids that have a follower in their word."""
    of = np.repeat(np.arange(len(n)), n)
    inner = np.flatnonzero(of[1:] == of[:-1])
    return of[inner], inner


def _prefix_counts(batches):
    """(kind, key, c, e): prefixes and how often they are whole words, pairs of ids inside words, ids with a follower, last ids."""
    for batch in batches:
        ids, n = _listed(batch.column(0))
        times = batch.column(1).to_numpy()
        begin, word, key = np.cumsum(n) - n, np.arange(len(n)), np.full(len(n), _ROOT)
        rows = [(PREFIX_ROW, key, times, 0 * times)]
        for j in range(min(int(n.max()), MAX_IDS) if len(n) else 0):
            live = n[word] > j
            word, key = word[live], key[live]
            key = next_key(key, ids[begin[word] + j])
            rows.append((PREFIX_ROW, key, times[word], times[word] * (n[word] == j + 1)))
        of, inner = _inner_pairs(ids, n)
        rows += [(kind, k, c, 0 * c) for kind, k, c in ((PAIR_ROW, pair_key(ids[inner], ids[inner + 1]), times[of]), (ID_ROW, ids[inner].astype(np.uint64), times[of]),
                                                        (LAST_ROW, ids[begin[n > 0] + n[n > 0] - 1].astype(np.uint64), times[n > 0]))]
        for kind in range(4):
            keys, c, e = (np.concatenate([r[i] for r in rows if r[0] == kind]) for i in (1, 2, 3))
            u, inverse = np.unique(keys, return_inverse=True)
            yield pa.record_batch({"kind": pa.array(np.full(len(u), kind), pa.int32()), "key": pa.array(u.view(np.int64))} | {
                name: pa.array(np.bincount(inverse, weights=x, minlength=len(u)).astype(np.int64)) for name, x in (("c", c), ("e", e))})
    give_back()


def _gaps(batches, c: Counts):
    """(h, place, kind, key) of the words' prefixes and pairs that ``c`` leaves out."""
    for batch in batches:
        ids, n = _listed(batch.column(0))
        h = batch.column(1).to_numpy()
        begin, word, key = np.cumsum(n) - n, np.arange(len(n)), np.full(len(n), _ROOT)
        rows = []
        for j in range(min(int(n.max()), MAX_IDS) if len(n) else 0):
            live = n[word] > j
            word, key = word[live], key[live]
            key = next_key(key, ids[begin[word] + j])
            gap = ~c.prefixes.find(key)[1]
            rows.append((h[word[gap]], np.full(gap.sum(), j), np.full(gap.sum(), PREFIX_ROW), key[gap]))
        of, inner = _inner_pairs(ids, n)
        key = pair_key(ids[inner], ids[inner + 1])
        gap = ~c.pairs.find(key)[1]
        rows.append((h[of[gap]], MAX_IDS + 1 + (inner - begin[of])[gap], np.full(gap.sum(), PAIR_ROW), key[gap]))
        h, place, kind, key = (np.concatenate([r[i] for r in rows]) for i in range(4))
        yield pa.record_batch({"h": pa.array(h), "place": pa.array(place, pa.int32()), "kind": pa.array(kind, pa.int32()), "key": pa.array(key.view(np.int64))})
    give_back()


def _with_words(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, str]:
    """(part, doc_id, text, held, spread) rows, and the folder of their parts' lists of what ``words`` (h, place, c, e, ids) says of
    their words. The row that ends a part has its distinct words and no text of its own."""
    spark = docs.sparkSession

    def run(batches):
        part, size, met = TaskContext.get().partitionId() << 24, 0, []

        def last():
            h = np.unique(np.concatenate(met)) if met else np.zeros(0, np.uint64)
            return pa.record_batch({"part": pa.array([part], pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "text": pa.nulls(1, pa.string()), "held": pa.nulls(1, pa.bool_()), "spread": pa.nulls(1, pa.list_(pa.int8())),
                                    "words": list_array(h.view(np.int64), [0, len(h)], pa.int64())})

        for batch in batches:
            for a, b, data, off in T.slices(batch.column(1)):
                w = T.words(data, off)
                met.append(np.unique(w.hash))
                yield pa.record_batch({"part": pa.array(np.full(b - a, part)), "doc_id": batch.column(0)[a:b], "text": batch.column(1)[a:b], "held": batch.column(2)[a:b],
                                       "spread": list_array(spread(w, b - a).ravel(), np.arange(b - a + 1) * BUCKETS, pa.int8()),
                                       "words": pa.nulls(b - a, pa.list_(pa.int64()))})
                size += len(data)
                if size >= PART:
                    yield last()
                    part, size, met = part + 1, 0, []
                    give_back()
        if size:
            yield last()
        met.clear()
        give_back()

    rows = keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held").mapInArrow(
        run, "part long, doc_id long, text string, held boolean, spread array<tinyint>, words array<long>"), "rows", "zstd")
    words = words.select("h", F.expr(PACKED).alias("q"), "ids").groupBy("h").agg(F.collect_list("q").alias("q"), F.max("ids").alias("ids"))
    found = rows.filter("words is not null").select("part", F.explode("words").alias("h")).join(words, "h")
    folder = scratch_path(spark, "rare")
    found.select("part", "h", "ids", "q").repartition("part").write.partitionBy("part").parquet(folder, compression="zstd")
    return rows.filter("text is not null").drop("words"), folder


def fit(docs: DataFrame) -> tuple[Model, DataFrame, str, int, int, int, Lookup]:
    """Of (doc_id, text, held): the model, the rows by part, the folder of the parts' rare counts, N, V, the number of training
    rows and the heavy words' counts."""
    spark = docs.sparkSession
    counts = (docs.select(F.coalesce("text", F.lit("")).alias("text"), "held").mapInArrow(_counts, "word string, c long")
              .groupBy("word").agg(F.sum("c").alias("c")))  # words of held-out rows alone count 0; their prefixes may be known

    def name(batches):
        for b in batches:
            ids, n = word_ids(b.column(0).to_pylist())
            off = np.concatenate(([0], 2 * np.cumsum(n))).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(ids.astype(np.uint16))])
            yield pa.record_batch({"c": b.column(1), "h": pa.array(_hashed(b.column(0)).view(np.int64)), "ids": ids})

    counts = keep(counts.mapInArrow(name, "c long, h long, ids binary"), "words", "zstd")
    n_docs = docs.filter(~F.col("held")).count()
    r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = r[0] + n_docs, r[1] + (n_docs > 0)
    frequent = (F.col("c") > 0) & (F.col("c") >= HEAVY * tokens)
    heavy = counts.filter(frequent).select("h", "c").toArrow()
    heavy = Lookup(heavy["h"].to_numpy().view(np.uint64), heavy["c"].to_numpy())

    nodes = keep(counts.filter("c > 0").select("ids", "c").mapInArrow(_prefix_counts, "kind int, key long, c long, e long")
                 .groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("e").alias("e")), "prefixes", "zstd")
    often = nodes.filter((F.col("kind") >= ID_ROW) | frequent).toArrow()  # ids, and keys of at least that share
    kind, key, c, e = (often[n].to_numpy() for n in ("kind", "key", "c", "e"))
    follow, last = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    follow[key[kind == ID_ROW]], last[key[kind == LAST_ROW]] = c[kind == ID_ROW], c[kind == LAST_ROW]
    of = lambda k: Lookup(key[kind == k].view(np.uint64), np.stack([c[kind == k], e[kind == k]]).astype(float))
    known = Counts(of(PREFIX_ROW), of(PAIR_ROW), follow, (last + 0.4) / (follow + last + 1))

    sent_known = spark.sparkContext.broadcast(known)
    rare = (counts.filter(~frequent).select("ids", "h").mapInArrow(lambda batches: _gaps(batches, sent_known.value), "h long, place int, kind int, key long")
            .join(nodes.filter((F.col("kind") < ID_ROW) & ~frequent), ["kind", "key"]).select("h", "place", "c", "e", F.lit(None).cast("binary").alias("ids")))
    zero = F.lit(0).cast("long")
    rows, folder = _with_words(docs, rare.unionByName(counts.select("h", F.lit(-1).alias("place"), F.when(frequent, zero).otherwise(F.col("c")).alias("c"), zero.alias("e"), "ids")))

    train = rows.filter(~F.col("held"))
    centres = topic_centres(train) if n_docs else np.zeros((1, BUCKETS))

    def topic_counts(batches):
        total = np.zeros((2 * VOCABULARY, TOPICS))
        for batch, words in Parts(folder, counts=False).of(batches):
            at = batch.column(1).flatten().to_numpy().reshape(-1, BUCKETS)
            best = (at @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)  # the nearest
            for a, b, _, _, s in _streams(batch.column(0), None, words):
                code = s["ids"] + VOCABULARY * s["start"]
                total += np.bincount(code * TOPICS + np.repeat(best[a:b], np.diff(s["first"])), minlength=2 * VOCABULARY * TOPICS).reshape(-1, TOPICS)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch({"code": pa.array(at, pa.int64())} | {f"t{k}": pa.array(total[at, k]) for k in range(TOPICS)})

    found = (train.select("text", "spread", "part").mapInArrow(topic_counts, "code long, " + ", ".join(f"t{k} double" for k in range(TOPICS)))
             .groupBy("code").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(TOPICS)]).toArrow())  # a row per id of the vocabulary at most
    total = np.zeros((2 * VOCABULARY, TOPICS))
    total[found["code"].to_numpy()] = np.stack([found[f"t{k}"].to_numpy() for k in range(TOPICS)], 1)
    topics = total.reshape(2, VOCABULARY, TOPICS).transpose(0, 2, 1)
    # Each topic leans on the ids of all topics, those on the vocabulary
    overall = topics.sum(axis=1, keepdims=True) + 0.02
    overall /= overall.sum(axis=2, keepdims=True)
    topics = topics + 0.002 * topics.sum(axis=2, keepdims=True) * overall + 2 * overall
    topics = topics / topics.sum(axis=2, keepdims=True)
    model = Model(topics, known)
    model.weights = _trained(train.select("part", "text"), model, folder)
    return model, rows, folder, tokens, distinct, n_docs, heavy


def _trained(texts: DataFrame, model: Model, folder: str) -> dict:
    """Attention weights: Adam over all windows of every text in each task, averaged over tasks by their windows."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = copy.copy(sent.value)
        m.together = BATCH
        flat = np.concatenate([m.weights[n].ravel() for n in SHAPES])
        ends = np.cumsum([int(np.prod(z)) for z in SHAPES.values()])[:-1]
        p = {n: w.reshape(z) for (n, z), w in zip(SHAPES.items(), np.split(flat, ends), strict=True)}  # views of the weights in one row
        mean, square, step, windows = np.zeros(len(flat)), np.zeros(len(flat)), 0, 0
        for batch, words in Parts(folder).of(batches):
            for _, _, _, _, s in _streams(batch.column(1), m, words, 1):
                for _, scored, args in m.windows(s):
                    windows += len(scored)
                    for _ in range(EPOCHS):
                        prob, kept = forward(p, *args)
                        grad = backward(p, args[0], args[1], args[4], prob, kept, scored)
                        g = np.concatenate([grad[n].ravel() for n in SHAPES])
                        step += 1
                        mean += 0.1 * (g - mean)
                        square += 0.01 * (g * g - square)
                        flat -= (RATE / (1 + step / 400) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        flat = flat.astype(float)
        yield pa.record_batch({"i": pa.array(np.arange(len(flat))), "n": pa.array(np.full(len(flat), float(windows))), "w": pa.array(flat * windows)})

    rows = texts.mapInArrow(run, "i long, n double, w double").groupBy("i").agg((F.sum("w") / F.greatest(F.sum("n"), F.lit(1.0))).alias("w"), F.sum("n").alias("n")).collect()
    if not rows or not rows[0].n:
        return model.weights
    flat = np.zeros(len(rows))
    flat[[r.i for r in rows]] = [r.w for r in rows]
    out, at = {}, 0
    for n, s in SHAPES.items():
        out[n] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = id_text(docs).withColumn("held", held_out)
    spark = docs.sparkSession
    model, rows, folder, tokens, distinct, n_docs, heavy = fit(docs)
    sent, sent_heavy = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(heavy)
    bottom = float(np.log10(tokens + 0.5 * (distinct + 1)))

    def run(batches):
        m, often = sent.value, sent_heavy.value
        for batch, words in Parts(folder).of(batches):
            for a, b, w, got, s in _streams(batch.column(1), m, words):
                k, doc = b - a, w.doc
                log = np.add.reduceat(m.log10(s), s["first"][:-1]) + np.bincount(doc, weights=got["log_end"], minlength=k)
                c, sure = often.find(w.hash)
                c = np.where(sure, c, got["rare"])
                n = np.diff(w.first) + 1
                base = np.bincount(doc, weights=np.log10(c + 0.5), minlength=k) + np.log10(n_docs + 0.5) - n * bottom
                yield pa.record_batch({
                    "doc_id": batch.column(0)[a:b], "held_out": batch.column(2)[a:b], "n_tokens": pa.array(n, pa.int64()),
                    "n_known": pa.array(np.bincount(doc[c > 0], minlength=k) + int(n_docs > 0), pa.int64()), "train_tokens": pa.array(np.full(k, tokens), pa.int64()),
                    "base_score": pa.array(base), "score": pa.array(log)})

    return rows.select("doc_id", "text", "held", "part").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(docs: DataFrame) -> DataFrame:
    return scores(docs, F.coalesce(in_part(5, 1), F.lit(True)))
