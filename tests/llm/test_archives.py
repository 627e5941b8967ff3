"""Archives with repeated pages and payloads: every record is read back, revisits resolve by address and date."""

import base64
import gzip
import hashlib
import io
import random

from riskspark.llm import warc


def expected(pages):
    """(page_id, bytes, digest, type, refers_to) of each row, written out plainly."""
    rows = [(i, (html or "").encode()) for i, _, html in pages]
    largest, count = {}, {}
    for i, body in rows:
        if i is not None:
            largest[body] = max(largest.get(body, i), i)
    out = []
    for i, body in rows:
        first_of_largest = i is not None and i == largest[body] and not count.get(body)
        if first_of_largest:
            count[body] = 1
        revisit = i is not None and not first_of_largest
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", largest[body] if revisit else None))
    return sorted(out, key=repr)


def rows(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", b"y") for i, u, h in pages], "page_id long, url string, html string, path string, payload binary")
    return sorted((tuple(r)[:5] for r in warc.round_trip(df.repartition(3)).collect()), key=repr)


def test_repeated_page_ids(spark):
    pages = [(1, "u", "a"), (1, "u", "b"), (2, "v", "a"), (3, "w", "b")]
    assert rows(spark, pages) == expected(pages)
    assert {r[4] for r in rows(spark, pages)} == {None, 2, 3}


def test_any_mixture(spark):
    rng = random.Random(5)
    bodies = ["", None, "same", "é" * 1000, "a\r\n\r\nWARC/1.0\n" * 40, "x" * 3_000_000, "HTTP/1.1 200 OK\r\n\r\nbody"]
    pages = [(rng.choice([None, *range(12)]), rng.choice([None, "http://a/b c", "filedesc:odd", "ü"]), rng.choice(bodies)) for _ in range(60)]
    assert rows(spark, pages) == expected(pages)


def test_other_readers_resolve_revisits(spark, monkeypatch):
    """A revisit names the response's own address and date; identifiers are unique; files hold whole gzip members."""
    monkeypatch.setattr(warc, "ROLL_BYTES", 2000)
    pages = [(i % 9, f"http://host/{i}", f"body {i % 4} " * 50) for i in range(40)]
    files = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4))
    heads = []
    for r in files.collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            got = list(warc.parse_warc(io.BytesIO(gzip.decompress(f.read()))))
        assert len(got) == r.records
        heads += [(h, b) for h, b in got if h["WARC-Type"] != "warcinfo"]
    assert len(heads) == 40 and len({h["WARC-Record-ID"] for h, _ in heads}) == 40
    responses = {(h["WARC-Target-URI"], h["WARC-Date"]): h["WARC-Payload-Digest"] for h, _ in heads if h["WARC-Type"] == "response"}
    revisits = [h for h, _ in heads if h["WARC-Type"] == "revisit"]
    assert len(responses) == 4 and len(revisits) == 36
    for h in revisits:
        assert responses[h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]] == h["WARC-Payload-Digest"]
    known = warc.read_warc(files).filter("type = 'response'").collect()
    assert sorted(r.payload.decode() for r in known) == sorted({p[2] for p in pages})
