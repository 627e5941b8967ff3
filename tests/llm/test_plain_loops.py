"""Fingerprints, removed passages, normal equations, isotonic steps and FTRL steps against plain loops."""

import math
import random
import re

import numpy as np
import pytest

from riskspark.llm import fingerprints, passage_dedup, quality, toxicity
from riskspark.llm import text as T

MASK = 2**64 - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(T.span_hash(data, np.array([0]), np.array([len(data)]))[0])


def words_of(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return {w for w in text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w}


def plain_fingerprint(text, lexicon):
    own = [word_hash(w) for w in words_of(text)]
    own = [h for h in own if h in lexicon] or own
    out = []
    for i in range(fingerprints.SUBSETS):
        salt = mix((i + 1) * 0x51ED2701A94C8D43 & MASK)
        kept = [m for m in (mix(h ^ salt) for h in own) if m < fingerprints._RATE[i]]
        out.append(mix(sum(mix(m) for m in kept) & MASK) % 0xFFFF + 1 if kept else 0)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_and_likeness(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(150)] + ["über", "Ünder", "ÉTÉ"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))).upper() if i % 5 == 0 else "\n".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "\t \n"), (103, "unheard words alone"), (104, texts[3][1]), (105, "long " * 30000)]
    low, high = 0.05, 0.3
    df = {}
    for _, t in texts:
        for w in words_of(t or ""):
            df[w] = df.get(w, 0) + 1
    band = {word_hash(w) for w, n in df.items() if low * len(texts) <= n <= max(1.0, high * len(texts))}
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in texts], "doc_id long, text string, edge int, part string")
    assert set(map(int, fingerprints.lexicon(docs, low, high))) == band and len(band) > 20
    order = sorted(texts, key=lambda x: -x[0])
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs.repartition(3), low, high).collect()}
    assert len(rows) == len(texts)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        own, cut, following = (plain_fingerprint(x, band) for x in (t, t[:len(t) - half] + after[:half], after))
        assert rows[i].fingerprint == "".join(f"{h:04x}" for h in own) and rows[i].edited_fingerprint == "".join(f"{h:04x}" for h in cut)
        assert rows[i].near_edited == pytest.approx(plain_likeness(own, cut)) and rows[i].near_next == pytest.approx(plain_likeness(own, following))


def test_normal_equations(spark):
    rng = np.random.default_rng(6)
    n = 70
    x = rng.normal(0, 2, (n, quality.FEATURES)).astype(np.float32)
    y, half = rng.integers(0, 2, n), rng.integers(0, 2, n)
    train = spark.createDataFrame([(x[i].tolist(), int(y[i]), int(half[i])) for i in range(n)], "x array<float>, y int, half int").repartition(5)
    mean, sd = x.mean(axis=0).astype(float), x.std(axis=0).astype(float)
    got = quality._equations(train, mean, sd)
    for h in (0, 1):
        total = np.zeros((quality.DIM + 1, quality.DIM + 2))
        for i in range(n):
            if half[i] == h:
                z = quality._cosines(x[i:i + 1].astype(float), mean, sd)[0]
                total += np.outer(z, np.append(z, y[i]))
        assert np.allclose(got[h], total, atol=1e-9)
        w = quality._solve(got[h])
        penalty = np.append(np.full(quality.DIM, quality.RIDGE), 1e-6)
        assert np.allclose(total[:, :-1] @ w + penalty * w, total[:, -1], atol=1e-6)


def test_isotonic_is_the_best_rising_fit():
    """Each value is the largest over starts of the smallest over ends of the weighted mean between them."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 15))
        weight = rng.integers(1, 9, n).astype(float)
        total = np.array([rng.integers(0, int(w) + 1) for w in weight], float)
        centre = np.arange(n).astype(float)
        knots, values = quality.isotonic(centre, weight, total)
        mean = lambda j, k: total[j:k + 1].sum() / weight[j:k + 1].sum()
        best = [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert np.all(np.diff(values) > 0) and np.all(np.diff(knots) > 0)
        assert np.allclose(sorted(set(np.round(best, 9))), values)


def test_ftrl_steps():
    rng = random.Random(3)
    model = toxicity.Ftrl()
    z, n = {}, {}

    def weight(p):
        l1 = 0.0 if p == 0 else toxicity.L1
        v = z.get(p, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((toxicity.BETA + math.sqrt(n.get(p, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(40):
        batch = [(sorted({0, *(rng.randrange(1, 30) for _ in range(6))}), rng.random() < 0.5) for _ in range(5)]
        doc = np.concatenate([np.full(len(p), i) for i, (p, _) in enumerate(batch)])
        model.step(doc, np.concatenate([p for p, _ in batch]).astype(np.int64), np.array([float(y) for _, y in batch]))
        old = {p: weight(p) for places, _ in batch for p in places}
        sums, squares = {}, {}
        for places, y in batch:
            g = 1 / (1 + math.exp(-sum(old[p] for p in places))) - y
            for p in places:
                sums[p], squares[p] = sums.get(p, 0.0) + g, squares.get(p, 0.0) + g * g
        for p in sums:
            grown = n.get(p, 0.0) + squares[p]
            z[p] = z.get(p, 0.0) + sums[p] - (math.sqrt(grown) - math.sqrt(n.get(p, 0.0))) / toxicity.ALPHA * old[p]
            n[p] = grown
        at = np.arange(30)
        assert np.allclose(model.weights(at), [weight(p) for p in at])
    assert any(weight(p) for p in range(1, 30)) and any(weight(p) == 0 for p in range(1, 30))


def plain_units(text):
    """(start, end, words) of whole text, paragraphs, lines, sentences and short lines with their neighbours, in order, each span once."""
    found = [(m.start(), m.end(), m[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    runs, lines, least = set(), [], passage_dedup.MIN_WORDS
    for kind in range(4):
        begin = 0
        for i, (_, end, word) in enumerate(found):
            feeds = text[end:found[i + 1][0]].count("\n") if i + 1 < len(found) else 9
            if i + 1 == len(found) or kind > 0 and feeds >= 2 or kind > 1 and feeds >= 1 or kind > 2 and word[-1] in ".!?":
                if kind == 0 or i + 1 - begin >= least:
                    runs.add((begin, i + 1))
                if kind == 2:
                    lines.append((begin, i + 1))
                begin = i + 1
    for begin, end in lines:
        if end - begin < least:
            runs |= {(begin, e) for _, e in [x for x in lines if x[1] - begin >= least][:1]} | {(a, end) for a, _ in [x for x in lines if end - x[0] >= least][-1:]}
    return [(found[a][0], found[b - 1][1], tuple(w for _, _, w in found[a:b])) for a, b in sorted(runs)]


def test_removed_passages(spark):
    rng = random.Random(21)
    lines = [" ".join(rng.choice("aa bb cc dd Éé ff gg hh".split()) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", "!", ". Then six more words follow here?"]) for _ in range(30)]
    texts = []
    for i in range(70):
        body = [rng.choice(lines) for _ in range(rng.randint(0, 7))]
        texts.append((i, "".join(x + rng.choice(["\n", "\n\n", " \n\t\n ", " "]) for x in body).upper() if i % 7 == 0 else "\n".join(body)))
    texts += [(80, None), (81, ""), (82, texts[5][1]), (83, "word " * 30000), (84, "word " * 30000 + "\nend of it all in six words")]
    texts += [(None, lines[0]), (85, texts[9][1]), (-3, texts[9][1])]
    units = [(i, u, *x) for i, t in texts if i is not None and t for u, x in enumerate(plain_units(t))]
    first = {}
    for i, u, _, _, words in units:
        first[words] = min(first.get(words, (i, u)), (i, u))
    want = set()
    for i in {x[0] for x in units}:
        reached = -1
        for _, u, start, end, words in sorted((x for x in units if x[0] == i and first[x[4]] < (x[0], x[1])), key=lambda x: (x[2], -x[3], x[1])):
            if end > reached:
                want.add((i, u, start, end, len(words), first[words][0]))
                reached = end
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, unit long, digest string")
    got = [tuple(r) for r in passage_dedup.removed_units(docs.repartition(4)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_copied_runs_of_short_lines_go_whole(spark):
    rng = random.Random(5)
    texts, planted = [], {}
    for case in range(40):
        block = [" ".join(f"c{case}w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        own = lambda x: " ".join(f"{x}{case}" for _ in range(rng.randint(1, 4)))
        texts.append((2 * case, f"{own('p')}\n" + "\n".join(block) + f"\n{own('q')}"))
        head = own("r")
        texts.append((2 * case + 1, f"{head}\n\n" + "\n".join(block).upper() + f"\n{own('s')}"))
        planted[2 * case + 1] = (len(head) + 2, len(head) + 2 + len("\n".join(block)), sum(len(x.split()) for x in block))
    texts += [(100, "N/A"), (101, " n/a\n"), (102, "other\nN/A\nwords")]
    got = {}
    for r in passage_dedup.removed_units(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert got.pop(101) == {1, 2, 3}
    for i, (start, end, words) in planted.items():
        text, covered = dict(texts)[i], got.pop(i, set())
        assert covered <= set(range(start, end))
        want = {at for at in range(start, end) if not text[at].isspace()} if words >= passage_dedup.MIN_WORDS else set()
        assert {at for at in covered if not text[at].isspace()} == want
    assert not got
