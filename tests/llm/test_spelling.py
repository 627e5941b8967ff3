"""Spelling variants against a plain loop over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskspark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, cell long, kind int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in texts], SCHEMA)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts):
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, out = {}, []
    for w, n in words.items():
        around = [v for v in words if near(v, w)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best
        out.append([w, form.get(w), w, n, len(around), words[form[w]] if w in form else None])
    for row in out:
        while row[2] in form:
            row[2] = form[row[2]]
    return sorted(tuple(r) for r in out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = ["an", "the", "er", "on", "ré", "sch", "ß", "ti", "À", "or", "é"]
    bases = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))) for _ in range(60)]
    pool = []
    for b in bases:
        pool += [b] * rng.choice([5, 12, 150])
        for _ in range(4):
            i, c = rng.randrange(len(b)), rng.choice("aeéxß")
            pool += [rng.choice([b[:i] + b[i + 1:], b[:i] + c + b[i:], b[:i] + c + b[i + 1:]])] * rng.randint(1, 30)
    pool += ["chainaaaa"] * 700 + ["chainaaab"] * 140 + ["chainaabb"] * 28 + ["chainabbb"] * 5  # a chain of forms
    pool += ["tiedwordq"] * 5 + ["tiedwordz"] * 25 + ["tiedworda"] * 25  # a tie
    rng.shuffle(pool)
    out = [(i, " 7,".join(pool[i * 40:(i + 1) * 40]).upper() if i % 9 == 0 else ".".join(pool[i * 40:(i + 1) * 40])) for i in range(len(pool) // 40 + 1)]
    out += [(1, out[1][1]), (None, "nulled ids count too. " * 9), (7000, None), (7001, ""), (7002, "!?×÷ Ā 漢字"), (7003, "z" * 5000 + " "), (7004, "thethe " * 4000)]
    return out + [(7005 + i, "z" * 5000 + "ő" + "z" * 4999) for i in range(5)]


def test_variants(spark, texts):
    want = brute(texts)
    assert any(r[1] and r[2] != r[1] for r in want) and ("tiedwordq", "tiedworda") in {(r[0], r[1]) for r in want}
    assert rows(spelling.variants(frame(spark, texts))) == want
    assert rows(spelling.variants(frame(spark, texts).repartition(5), sample=70, cell=16)) == want  # many cells from a small sample


def test_empty(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (None, ""), (2, "short words only")])).count() == 0


def test_reach_finds_all_near():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(7)) for _ in range(3000)})
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    code = spelling.codes(data, np.arange(len(words) + 1) * 7)
    numbers = iter(range(1 << 30))
    for root in (spelling.grow(code, 20, True), spelling.grow(code[::7], 5, False, numbers)):
        at = spelling.home(root, code) if isinstance(next(spelling.reach(root, code, 1, 1))[0], int) else None
        got = set()
        for leaf, rows_ in spelling.reach(root, code, 1, 1):
            inside = np.flatnonzero(at == leaf) if at is not None else leaf
            got |= {(q, w) for q in rows_.tolist() for w in inside.tolist()}
        for q in range(0, len(words), 25):
            for w in range(len(words)):
                if near(words[q], words[w]):
                    assert (q, w) in got
