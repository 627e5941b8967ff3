"""Conversation repair against a search over all edit sequences, and its defined cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from riskspark.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, there boolean, audit string"


def search(turns):
    """Least (cost, audit) over every sequence of edits: turns are (initial, must go, truncated)."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(turns) and state in (0, 3) else []
        if inserted < 2:
            for to in {0: [2], 1: [2], 2: [3], 3: [2]}[state]:
                c, a = best(i, to, inserted + 1)
                found.append((c + 5, "I" + a))
        if i < len(turns):
            f, gone, cut = turns[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            for letter, to in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]:
                if not gone and (f == letter or letter != "s"):
                    c, a = best(i + 1, to, 0)
                    found.append((c + (f != letter) + 5 * cut, ("K" if f == letter else "R") + a))
        return min(found, default=(10**9, ""))
    return best(0, 0, 0)


def expected(rows):
    """Result by conv_id of (conv_id, turn, role, text) rows, written out plainly."""
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        here = convs.setdefault(c, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, count = set(), [], [0, 0, 0]
        for _, role, text in here:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        marks = [role[:1] for _, role, _ in here]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        numbers = [t for t, _, _ in here if t is not None]
        cost, audit = search(tuple(turns))
        lines, i, last = [], 0, ""
        for e in audit:
            if e in "KRI":
                role = here[i][1] if e == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{'' if e == 'I' else here[i][2]}")
                last = role[:1]
            i += e != "I"
        out[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *count, illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in range(80):
        turn = rng.choice([0, 1, -3])
        for _ in range(rng.randint(1, 14)):
            turn += rng.choice([1, 1, 1, 0, 3])
            out.append((c, rng.choice([turn] * 9 + [None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                        rng.choice(["Yes.", "No!", "cut off", "Well? \n", "", " \t", None, f"Turn {turn}."])))
    out += [(900, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(200)]  # longer than a block
    out += [(901, t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice([f"Line {t}.", "again.", "cut"])) for t in range(170)]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return out + [(dropped, 1, "user", "Gone."), (None, None, None, None), (None, 2, "user", "Hi."), (950, 1, "user", "é" * 50000 + "."), out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, False, "x") for r in rows], SCHEMA)


def test_audits(spark, rows):
    want = expected(rows)
    got = turn_repair.query(frame(spark, rows)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert {e for w in want.values() for e in w[6]} == set("KRD")  # at 2 against 5 a deletion is always cheaper than an insertion


def test_blocks_agree(monkeypatch, rows):
    """Cut into blocks of a few rows, every conversation has the same audit and hash."""
    want = expected(rows)
    for block in (1, 3, 7):
        monkeypatch.setattr(turn_repair, "BLOCK", block)
        for c in range(80):
            conv = turn_repair.Conversation(c)
            here, seen = [], set()
            for i, t, role, text in rows:
                if i == c:
                    kind = zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
                    role, text = " " if role is None else role, " " if text is None else text
                    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                    here += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
            here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
            for t, role, text in here:
                conv.add(t, role, text, (role, text) in seen)
                seen.add((role, text))
            assert tuple(conv.row().values())[1:] == want[c]


def test_align_is_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        turns = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 9)))
        best = turn_repair.cheapest(turns, 0, (0, 3))
        assert min(best.values()) == search(tuple((t.lower(), t == "x", t.isupper()) for t in turns))
        for target in ("", "ua", "sua", "uaua", "suauauaua"):
            full = turn_repair.align(turns, target, 10**6)
            if full:
                assert turn_repair.align(turns, target, full[0]) == full and turn_repair.align(turns, target, full[0] - 1) is None


def test_repaired_turns(spark, rows):
    damaged = turn_repair.damaged(frame(spark, rows))
    found = turn_repair.audits(damaged)
    by = {}
    for r in turn_repair.repaired_turns(damaged, found).collect():
        by.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        lines = sorted(by.get(r.conv_id, []), key=lambda x: x.line)
        assert "".join(x.edit for x in lines) == r.audit
        text = "\n".join(f"{x.role}:{x.text}" for x in lines if x.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in lines if x.edit != "D"))


def test_empty(spark):
    assert turn_repair.query(frame(spark, [])).count() == 0
