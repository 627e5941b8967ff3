"""Operators against brute force on small fixtures, and their defined cases."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from riskspark.llm import attention_lm, decontaminate, fingerprints, line_dedup, near_dedup, packing, passage_dedup, quality, toxicity, warc
from riskspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        texts.append((i, " ".join(body)))
        if i % 6 == 0:
            near = list(body)
            near[rng.randrange(len(near))] = "changed"
            texts += [(100 + i, " ".join(near)), (200 + i, " ".join(body).upper())]
    return texts + [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "x " * 30000), (None, "w1 w2 w3 w4 w5 w6"), (0, texts[0][1])]


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(low[i:i + 5]) for i in range(max(1, len(low) - 4))} if low else set()


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(frame(spark, corpus), block=4).collect()
    assert len(got) == len(corpus)
    sets = {i: shingles(t) for i, t in corpus if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in root):
            break
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def test_passages(spark):
    passage = "This passage has more than six words. And so has its second sentence here! Short one."
    texts = [(1, "Start of it " + passage + " end"), (2, f"Éa. Other beginning\n{passage.upper()}"), (3, "Nothing is copied in this document at all."), (4, None), (5, "")]
    got = passage_dedup.removed_units(frame(spark, texts)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2, 1)}
    assert [texts[1][1][r.start:r.end] for r in got] == ["AND SO HAS ITS SECOND SENTENCE HERE!"]


def test_passages_of_short_sentences(spark):
    line, poem = "It rains. We wait. He sings. All sleep.", "One two three.\nFour five.\n\nSix seven."
    texts = [(1, f"First text here.\n{line}\nIts own end."), (2, f"Élan, other beginning!\n{line.upper()}\nOther end."), (3, poem), (4, f" {poem}\n"),
             (5, "Before it.\n\nAn old line\nof four more words\n\nAfter."), (6, "An old line\nof four more words\n\nElse. It rains.")]
    got = passage_dedup.removed_units(frame(spark, texts)).collect()
    assert {(r.doc_id, r.kept_doc_id, dict(texts)[r.doc_id][r.start:r.end], r.words) for r in got} == {
        (2, 1, line.upper(), 8), (4, 3, poem, 7), (6, 5, "An old line\nof four more words", 7)}
    assert len(got) == 3


def test_line_windows(spark):
    texts = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na"), (4, None), (5, "a\nb"), (6, "\n\n\n\n"), (None, "a\nb\nc")]
    got = {r.doc_id: r for r in line_dedup.query(frame(spark, texts)).collect()}
    assert got[1].text == "a\nb\nc\nd" and got[2].text == "x\ny" and got[2].removed_lines == "1,2,3"
    assert got[3].text == "a" and got[4].text is None and got[5].n_removed == 0 and got[6].n_removed == 0 and got[None].text == "a\nb\nc"


def test_decontamination(spark):
    item = [f"t{i}" for i in range(30)]
    changed = [("zz" if i % 9 == 4 else w) for i, w in enumerate(item)]
    noise = [f"n{i}" for i in range(40)]
    docs = frame(spark, [(1, " ".join(noise + item + noise)), (2, ". ".join(noise[:5] + changed)), (3, " ".join(noise)), (4, " ".join(item[:15])), (5, None), (6, "five short words in all"), (1, " ".join(noise + item + noise)), (7, " ".join(item[i] if i % 2 else "q" for i in range(30)))])
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "Five short words in all"), (13, "two words")], "item_id long, text string")
    for size in (decontaminate.BROADCAST_BYTES, 0):
        got = {(r.doc_id, r.item_id): (r.doc_token, r.equal_tokens) for r in decontaminate.leaks(docs, bench, broadcast_bytes=size).collect()}
        assert got == {(1, 10): (40, 30), (2, 10): (5, 27), (4, 10): (0, 15), (6, 12): (0, 5)}


def test_packing(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(i, t) for i, t in corpus if i is not None][:-1] + [(2000, "odd  space　here  <|endoftext|> it's\r\n\r\n  done 12345.  ")]
    rows = packing.pack(frame(spark, texts)).collect()
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    seen, size = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert all(seen[i] == len(ids[i]) for i in ids)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size.get(r.sequence_id, 0)
        size[r.sequence_id] = r.offset + r.length
    assert max(size.values()) <= 2048


def test_plan_is_cheapest():
    rng = random.Random(1)
    for _ in range(30):
        at = [0, *sorted(rng.sample(range(1, 60), 12))]
        at = [a for i, a in enumerate(at) if i == 0 or a - at[i - 1] <= 16]
        if any(b - a > 16 for a, b in zip(at, at[1:])):
            continue
        fee = [0.0, *[rng.choice([0.0, 3.0]) for _ in at[1:]]]
        best = {0: 0.0}
        for j in range(1, len(at)):
            cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
            best[j] = fee[j] + min(best[i] + cost(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16)
        cuts = packing.plan(np.array(at), np.array(fee), 16)
        total = sum((0 if n & (n - 1) == 0 else 16 - n) + fee[at.index(c)] for c, n in zip(cuts, np.diff([0, *cuts]).tolist()))
        assert total == best[len(at) - 1] and cuts[-1] == at[-1]


def test_packing_makes_few_calls():
    """Neither a cut place nor a new piece of text costs a dozen calls (op4's CPU seconds)."""
    pytest.importorskip("tokenizers")
    import sys

    from riskspark.llm.subwords import Subwords, default_path

    def calls(fn):
        n = [0]
        sys.setprofile(lambda frame, event, arg: n.__setitem__(0, n[0] + (event == "c_call")))
        try:
            fn()
        finally:
            sys.setprofile(None)
        return n[0]

    at = np.arange(0, 40_000, 8)
    assert calls(lambda: packing.plan(at, np.zeros(len(at)), 2048)) < 6 * len(at)
    own = Subwords(default_path())
    words = [f" w{i * 7919 % 100003:x}" for i in range(5000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    assert calls(lambda: own.encode(data, np.array([0, len(data)]))) < len(words)


@pytest.mark.parametrize("raw", [b" caf\xe9 bad \xff\xfe x y", " a\u00a0\n\n b \u2003\n\n\nc".encode(), b"x\n\n\n y  z\t\t1"])
def test_ids_of_pieces(raw):
    """What a text's pieces are tokenized with changes none of their ids, broken UTF-8 included."""
    pytest.importorskip("tokenizers")
    from riskspark.llm.subwords import Subwords, default_path

    own = Subwords(default_path())
    data = np.frombuffer(raw, np.uint8)
    space = np.isin(data, [32, *range(9, 14)])
    start = np.flatnonzero(np.diff(space.astype(int), prepend=0) == 1 if space[0] else np.r_[True, space[1:] & ~space[:-1]])
    end = np.append(start[1:], len(data))
    ids, begin, count = own.each(data, start, end)
    for s, e, b, n in zip(start, end, begin, count):
        assert ids[b:b + n].tolist() == own.whole(raw[s:e].decode("utf-8", "replace")).tolist()


def test_archives(spark):
    pages = [(1, "http://a/x y", "<p>é</p>"), (2, None, "same"), (3, "http://b", "same"), (4, "u", None), (5, "u", ""), (6, "v", "a\r\n\r\nWARC/1.0\n" * 50)]
    rows = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(rows) == 6
    for i, _, html in pages:
        body = (html or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {i: r.refers_to for i, r in rows.items()} == {1: None, 2: 3, 3: None, 4: 5, 5: None, 6: None}
    assert {i for i, r in rows.items() if r.record_type == "revisit"} == {2, 4}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(warc.version_block("1") + warc.arc_record("1", "u", b"12345")[:-4])))
    for version in "12":
        kept = list(warc.parse_arc(io.BytesIO(warc.version_block(version) + warc.arc_record(version, "u v", b"a\nb") + warc.arc_record(version, "w", b""))))
        assert [r["block"] for r in kept[1:]] == [b"a\nb", b""] and kept[1]["URL"] == "u%20v"
    head, block = next(warc.parse_warc(io.BytesIO(gzip.decompress(gzip.compress(warc.warc_record("u", "20240102030405", "resource", b"xy", "text/plain"))))))
    assert head["WARC-Date"] == "2024-01-02T03:04:05Z" and block == b"xy"


def test_fingerprints(spark, corpus):
    texts = [(i, t) for i, t in corpus if i is not None][:-1]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: -x[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert rows[i].n_chars == len(t) and 0 <= rows[i].near_edited <= 1
        assert rows[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()
    assert rows[6].fingerprint == rows[206].fingerprint and rows[900].fingerprint == rows[901].fingerprint != rows[903].fingerprint
    assert fingerprints.fingerprints(frame(spark, [(1, "only one")])).first().near_next == 1.0


def test_language_model(spark, corpus):
    docs = frame(spark, corpus)
    rows = attention_lm.query(docs).collect()
    assert len(rows) == len(corpus)
    words = {(i, t): (t or "").translate(attention_lm._LOWER.decode("latin-1")).split() + [None] for i, t in corpus}
    train = [w for (i, t), w in ((k, words[k]) for k in [(i, t) for i, t in corpus]) if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for w in (x for ws in train for x in ws):
        counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = [ws for (i, t), ws in words.items() if i == r.doc_id]
        base = [sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in own]
        assert r.train_tokens == n and np.isfinite(r.score) and r.score < 0
        assert any(abs(r.base_score - b) < 1e-6 and r.n_tokens == len(ws) and r.n_known == sum(w in counts for w in ws) for b, ws in zip(base, own))


def test_rare_counts_of_the_language_model(spark, corpus, monkeypatch):
    """Counts that are not sent to all tasks say the same as counts that are."""
    seen = {}
    monkeypatch.setattr(attention_lm, "PART", 3000)  # several parts a task
    for heavy in (0.0, 0.5):
        monkeypatch.setattr(attention_lm, "HEAVY", heavy)
        attention_lm._memo[0] = attention_lm.Memo()
        docs = frame(spark, corpus).selectExpr("doc_id", "text", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, true) held")
        model, rows, folder, *_ = attention_lm.fit(docs)
        total = np.zeros(3)
        for batch, rare in attention_lm.Parts(folder).of(rows.orderBy("part").toArrow().combine_chunks().to_batches()):
            for _, _, w, got, _ in attention_lm._streams(batch.column("text"), model, rare):
                seen.setdefault(heavy, {}).update({int(h): x for h, x in zip(w.hash, got["log_end"])})
                total += [float(got[n].sum()) for n in ("share", "pair", "seen")]
        seen[heavy, "sum"] = total
    assert seen[0.0] and seen[0.0].keys() == seen[0.5].keys()
    assert all(abs(x - seen[0.5][h]) < 1e-9 for h, x in seen[0.0].items())
    assert np.allclose(seen[0.0, "sum"], seen[0.5, "sum"], atol=0.05)


def test_weights_see_every_window(spark, monkeypatch):
    """The fit goes over each id of the training texts, and over one end mark a text."""
    text = " ".join(f"w{i % 7}" for i in range(500))
    docs = frame(spark, [(1, text), (2, "one two")]).selectExpr("doc_id", "text", "false held")
    model, rows, folder, *_ = attention_lm.fit(docs)
    texts, seen, plain = rows.select("part", "text"), [], attention_lm.Model.windows

    def windows(self, s):
        for target, scored, args in plain(self, s):
            seen.extend(s["ids"][target[scored]].tolist())
            yield target, scored, args

    class Here:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            list(run(texts.toArrow().combine_chunks().to_batches()))
            return texts.mapInArrow(run, schema)

    monkeypatch.setattr(attention_lm.Model, "windows", windows)
    attention_lm._trained(Here(), model, folder)
    ids = sum(len(attention_lm.word_ids([w])[0]) for w in (text + " one two").split())
    assert (len(seen), seen.count(attention_lm.END)) == (ids + 2, 2)


def test_probabilities_add_up_to_one(spark, corpus):
    """Over the whole vocabulary and the end mark: at a text's start, inside a word, and after some words."""
    m = attention_lm
    docs = frame(spark, corpus).selectExpr("doc_id", "text", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, true) held")
    model, *_ = m.fit(docs)
    model.weights = {k: v + np.random.default_rng(1).normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.weights.items()}
    every, c = np.arange(m.VOCABULARY), model.counts
    root = np.array([m._ROOT])
    words = float(c.prefixes(root)[0, 0])
    first_id = m.word_ids(["w17"])[0][0]

    def total(before, starts, inside):
        """Sum over the id that follows the ids ``before``."""
        k = len(before)
        ids = np.concatenate([np.tile(before, (len(every), 1)).astype(np.int64), every[:, None]], 1)
        start = np.zeros(ids.shape, bool)
        start[:, :k], start[:, k] = starts, not inside
        share, pair, seen = (np.full(ids.shape, v, np.float32) for v in (-1, -1, 0))
        prefix = m.next_key(np.repeat(root, len(every)), np.full(len(every), before[-1])) if inside else np.repeat(root, len(every))
        count, stop = c.prefixes(prefix) if inside else (np.full(len(every), words), 0)
        after = c.prefixes(m.next_key(prefix, every))[0]
        share[:, k] = np.where(count > 0, np.where(every == m.END, 0, after) / np.maximum(count - stop, 1), -1)
        seen[:, k] = np.log1p(count) / 4
        if inside:
            both = c.pairs(m.pair_key(np.full(len(every), before[-1]), every))[0]
            pair[:, k] = both / c.follow[before[-1]] if c.follow[before[-1]] else -1
        s = {"ids": ids.ravel(), "start": start.ravel(), "share": share.ravel(), "pair": pair.ravel(), "seen": seen.ravel(), "first": np.arange(len(every) + 1) * (k + 1)}
        return (10.0 ** model.log10(s).reshape(ids.shape)[:, k]).sum()

    assert abs(total(np.zeros(0, np.int64), [], False) - 1) < 1e-3
    assert abs(total(np.array([first_id]), [True], False) - 1) < 1e-3
    assert abs(total(np.array([first_id]), [True], True) - 1) < 1e-3
    stream = next(m._streams(__import__("pyarrow").array(["w17 w3"]), model))[4]  # the stream that scoring uses says the same of an end mark
    assert stream["ids"][-1] == m.END and (stream["share"][-1], stream["pair"][-1]) == (0, -1) and abs(stream["seen"][-1] - np.log1p(words) / 4) < 1e-6


def test_attention_gradients_and_causality():
    rng, m, n = np.random.default_rng(4), attention_lm, 5
    weights = {k: rng.normal(0, 0.4, shape) for k, shape in m.SHAPES.items()}
    x = rng.normal(0, 1, (n, m.SPAN, m.INPUT))
    x[..., -1] = 1
    valid = rng.random((n, m.SPAN)) < 0.8
    valid[:, m.CONTEXT] = True
    now, known = rng.random((n, m.STEP, 2)), rng.random((n, m.STEP, 2)) < 0.6
    like, scored = rng.random((n, m.STEP, m.TOPICS + 2)), rng.random((n, m.STEP)) < 0.7
    like[..., m.TOPICS:] *= known

    def loss(w):
        return -np.log(m.forward(w, x, valid, now, known, like)[0][scored]).sum() / scored.sum()

    prob, kept = m.forward(weights, x, valid, now, known, like)
    for name, grad in m.backward(weights, x, valid, like, prob, kept, scored).items():
        for place in [tuple(rng.integers(0, d) for d in grad.shape) for _ in range(6)]:
            high, low = ({k: w.copy() for k, w in weights.items()} for _ in range(2))
            high[name][place] += 1e-3
            low[name][place] -= 1e-3
            assert abs((loss(high) - loss(low)) / 2e-3 - grad[place]) < 2e-4, (name, place)
    later = x.copy()
    later[:, m.CONTEXT + 4:, :-1] += 1  # inputs of later ids change nothing before them
    after = m.forward(weights, later, valid, now, known, like)[0]
    assert np.allclose(after[:, :4], prob[:, :4]) and not np.allclose(after[:, 4:], prob[:, 4:])


def test_windows_in_blocks_are_windows_of_their_own():
    """Blocks that two windows share give the probabilities and gradients of windows that are given whole."""
    rng, m, n = np.random.default_rng(7), attention_lm, 6
    weights = {k: rng.normal(0, 0.4, shape) for k, shape in m.SHAPES.items()}
    blocks, begins = rng.normal(0, 1, (n + 1, m.STEP, m.INPUT)), np.array([0, 3])
    blocks[..., -1] = 1
    now, known = rng.random((n, m.STEP, 2)), rng.random((n, m.STEP, 2)) < 0.6
    like, scored = rng.random((n, m.STEP, m.TOPICS + 2)), rng.random((n, m.STEP)) < 0.7
    x, valid = np.concatenate([blocks[:-1], blocks[1:]], 1), np.ones((n, m.SPAN), bool)
    valid[begins, : m.CONTEXT] = False
    found = []
    for args in ((blocks, begins), (x, valid)):
        prob, kept = m.forward(weights, *args, now, known, like)
        found.append((prob.copy(), m.backward(weights, *args, like, prob, kept, scored)))
    assert np.allclose(found[0][0], found[1][0])
    assert all(np.allclose(grad, found[1][1][name]) for name, grad in found[0][1].items())


def test_words_are_tokenized_once(spark, corpus, monkeypatch):
    """Passes over the texts take the ids from their part's list; words that are tokenized together get the ids that they get alone."""
    m = attention_lm
    words = ["plain", "don't", "x1y2", "a\u00a0b", "\u00a0", "\u00a0\u00e9", "\u3000z", "...", "caf\u00e9", "\u4e2d\u6587", "1234567", "_"]
    for some in (words, words[::-1], []):
        alone = [m._encoder()[0].encode_ordinary(" " + w) for w in some]
        ids, n = m.word_ids(some)
        assert ids.tolist() == [i for x in alone for i in x] and n.tolist() == [len(x) for x in alone]
    docs = frame(spark, corpus).selectExpr("doc_id", "text", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 1, true) held")
    model, rows, folder, *_ = m.fit(docs)
    batches = rows.orderBy("part").toArrow().combine_chunks().to_batches()
    told = [s["ids"].tolist() for b, _ in m.Parts(folder).of(batches) for *_, s in m._streams(b.column("text"), None)]
    monkeypatch.setattr(m, "word_ids", lambda words: pytest.fail("tokenized again"))
    for counts in (model, None):
        assert told == [s["ids"].tolist() for b, part in m.Parts(folder, counts is not None).of(batches) for *_, s in m._streams(b.column("text"), counts, part)]


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers(spark, name):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        body = [rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(40)) for _ in range(40)]
        if bad:
            body = [w.upper() + "!!" for w in body] if name == "quality" else body + ["idiot"]
        rows.append((i, " ".join(body)))
        labels.append((i, int(not bad), int(bad)))
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (None, "alpha")])
    known = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    module = quality if name == "quality" else toxicity
    got = module.query(docs, known).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: (q if name == "quality" else t) for i, q, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert module.query(docs, known.limit(0)).count() == 303


@pytest.mark.parametrize("run", [
    lambda s, d: near_dedup.near_duplicates(d), lambda s, d: passage_dedup.removed_units(d), lambda s, d: packing.pack(d), lambda s, d: fingerprints.fingerprints(d),
    lambda s, d: attention_lm.query(d), lambda s, d: line_dedup.query(d), lambda s, d: quality.query(d, s.createDataFrame([], "doc_id long, quality int")),
    lambda s, d: toxicity.query(d, s.createDataFrame([], "doc_id long, toxic int")),
    lambda s, d: decontaminate.leaks(d, s.createDataFrame([], "item_id long, text string"))])
def test_empty_tables(spark, run):
    assert run(spark, frame(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [set(r.doc_id for r in docs.select("doc_id").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, sf), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        ids.append(set(r.doc_id for r in docs.select("doc_id").collect()))
        assert ids[-1] <= ids[-2] and len(ids[-1]) > 100
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == ids[-1]


def test_topics_come_from_every_training_text(spark, monkeypatch):
    """The topics' start takes all training texts, and texts of the same words lie at the same place."""
    seen, plain = [], attention_lm.topic_centres
    monkeypatch.setattr(attention_lm, "topic_centres", lambda rows: seen.append(rows.count()) or plain(rows))
    texts = ["alpha beta gamma delta", "uno dos tres cuatro", "delta gamma beta alpha", ""]
    docs = frame(spark, [(i, texts[i % 4]) for i in range(2000)]).selectExpr("doc_id", "text", "doc_id % 5 = 1 held")
    rows = attention_lm.fit(docs)[1]
    assert seen == [1600]
    spread = {r.text: tuple(r.spread) for r in rows.select("text", "spread").distinct().collect()}
    assert len(spread) == 4 and spread[texts[0]] == spread[texts[2]] != spread[texts[1]] and set(spread[""]) == {0}
    assert abs(sum(x * x for x in spread[texts[0]]) - 127**2) < 600
