import hashlib

from motifspark.llm import warc
from motifspark.llm.common import cut


def test_round_trip_revisits_and_seeks(spark):
    long = "é" * 60
    rows = [(5, "http://a/", long, 1), (3, None, long, 1), (3, "http://a/\r\nx", long, 1), (9, "u", "short", 1), (10, "u", "short", 1), (11, "u", None, 1), (None, "u", long, 1), (12, "u", "x" * 700_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").coalesce(1)
    bundles = cut(warc.write_bundles(pages))
    out = sorted(map(tuple, warc.read_bundles(bundles).drop("url", "payload").collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), *(("revisit", 3) if h == long and i != 3 else ("response", None))) for i, _, h, _ in rows]
    assert out == sorted(want, key=str)
    payloads = lambda name: [bytes(r["payload"]) for r in warc.read_record(bundles, name).collect()]
    assert payloads("12") == [b"x" * 700_000] and payloads("9") == [b"short"] and payloads("nine") == []
    named = pages.selectExpr("concat('p', page_id) AS page_id", "url", "html")
    assert {(r["page_id"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(named), "string").collect()} == {(None if i is None else f"p{i}", "p3" if h == long and i != 3 else None) for i, _, h, _ in rows}
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0


def test_identifiers_of_any_characters_and_repeated_rows(spark):
    names = ["a\r\nWARC-Type: revisit", "50% > 40%", " blank ", "é 日本", "%41", "plain"]
    same = "<p>" + "x" * 200
    rows = [(n, f"http://a/{i}", same, n, b"x") for i, n in enumerate(names)] * 2 + [("zero", None, None, "z", b"y")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, data string, bundle binary")
    found = warc.read_bundles(warc.write_bundles(pages), "string").select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    first = min(names)
    want = [(n, "response" if n == first else "revisit", None if n == first else first, 203) for n in names] * 2 + [("zero", "response", None, 0)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
