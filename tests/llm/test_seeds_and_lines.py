"""Every substitution that the decontamination rule allows; line dedup with clashing columns."""

import itertools
import math

import pytest

from riskspark.llm import decontaminate, line_dedup


@pytest.mark.parametrize("length", [5, 6, 7, 8, 9, 10, 11, 12, 13, 20])
def test_no_allowed_substitution_is_lost(spark, length):
    """Each item stands alone in its table, so no other item's masks help."""
    item = [f"w{i}" for i in range(length)]
    window = min(length, 13)
    allowed = window - math.ceil(window * 0.8)
    texts, want = [], set()
    for start in {0, length - window}:
        for k in (allowed, allowed + 1):
            for gone in itertools.combinations(range(start, start + window), k):
                outside = [i for i in range(length) if not start <= i < start + window]
                body = [f"x{i}" if i in gone or i in outside else t for i, t in enumerate(item)]
                texts.append((len(texts), " ".join(["before", "it", *body, "after"])))
                best = max(sum(body[j] == item[j] for j in range(i, i + window)) for i in range(length - window + 1))
                if best >= math.ceil(window * 0.8):
                    want.add(texts[-1][0])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == want and len(want) < len(texts)
    assert all(r.doc_token == 2 for r in got)
    if length in (7, 13):
        assert {r.doc_id for r in decontaminate.leaks(docs, bench, broadcast_bytes=0).collect()} == want


def test_line_dedup_keeps_clashing_columns(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [(i, t, 7, "a", "b", [9], 5, "c") for i, t in ((1, text), (2, "x\n" + text), (3, None), (None, text), (4, ""))]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n_lines int, _lines string, _covered_id string, _removed array<int>, lines int, `a.b` string")
    out = line_dedup.dedup_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "x" and got[2]._removed == [1, 2, 3, 4] and got[1].text == text and got[None].text == text and got[3].text is None
    assert all((r._lines, r._covered_id, r.lines, r["a.b"]) == ("a", "b", 5, "c") for r in got.values())
    assert len(out.columns) == 8
