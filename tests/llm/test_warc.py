"""Archives: exact round trip, framing, digests, revisits."""

import base64
import gzip
import hashlib

import pytest

from leadloom.llm import warc

PAGES = [
    (1, "https://a.example/x", "<p>" + "long " * 400), (5, "https://a.example/y", "<p>" + "long " * 400),
    (9, "http://é.example/\r\nz", "<p>" + "long " * 400), (2, None, None), (3, "", ""), (4, "u", "short"), (6, "u", "short"),
    (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "WARC/1.1\r\n\r\n" * 9000), (9, "twice", "<p>" + "long " * 400),
    (None, "nameless", "<p>" + "long " * 400), (11, "u", "a" * 999), (12, "u", "a" * 999),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, records string")


def expected(rows):
    best = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(html)
        again = keeper is not None and page != keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    read = warc.written_and_read(frame(spark)).collect()
    number = lambda x: None if x is None else int(x)
    got = [(number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in read]
    assert sorted(got, key=str) == expected(PAGES)


def test_payloads_come_back(spark):
    rows = {p: (u, h) for p, u, h in PAGES if p not in (9, None)}
    df = frame(spark, [(p, *uh) for p, uh in rows.items()])
    for r in warc.read_archives(warc.archives(df.select("page_id", "url", "html")), keep_payload=True).collect():
        assert bytes(r.payload) == (rows[int(r.page_id)][1] or "").encode()
        assert r.url == rows[int(r.page_id)][0]


def test_no_pages(spark):
    assert warc.written_and_read(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 13, 1 << 16])
def test_reader_takes_any_chunks(size):
    data = warc.record("urn:page:1", "u", b"abc" * 70_000) + warc.record("urn:page:2", None, b"") + warc.record(
        "urn:page:3", "u", b"abc" * 70_000, refers_to="urn:page:1")
    if size < 100:
        data = warc.record("urn:page:1", "u", b"abc" * 70) + data[len(warc.record("urn:page:1", "u", b"abc" * 70_000)):]
    found = list(warc.records(data[k:k + size] for k in range(0, len(data), size)))
    assert [r.kind for r in found] == ["response", "response", "revisit"]
    assert found[2].payload_bytes == 210_000 and found[2].payload is None
    assert found[2].headers["warc-refers-to"] == "<urn:page:1>"
    assert found[0].payload in (b"abc" * 70, b"abc" * 70_000)


def test_one_member_per_record():
    one = warc.record("urn:page:1", "u", b"hello")
    text = gzip.decompress(one)
    head, _, block = text.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"hello\r\n\r\n")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    assert f"WARC-Payload-Digest: {digest}".encode() in head


def repacked(change):
    return gzip.compress(change(gzip.decompress(warc.record("urn:page:1", "u", b"hello world"))))


@pytest.mark.parametrize("change", [
    lambda t: t.replace(b"hello", b"jello"), lambda t: t[:-6], lambda t: t + b"more",
    lambda t: t.replace(b"WARC/1.1", b"HTTP/1.1", 1), lambda t: t[:40],
])
def test_damage_is_found(change):
    with pytest.raises(ValueError, match=r"digest|record|header"):
        list(warc.records([repacked(change)]))


def test_cut_archive_is_found():
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records([warc.record("urn:page:1", "u", b"hello" * 100)[:-9]]))
