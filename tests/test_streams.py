"""Chunked and streamed search: any cut of a text, resets, gaps, late and repeated chunks, bounded state."""

import random
from datetime import datetime, timedelta

import pytest

from motifspark.streaming import chunks as module
from motifspark.streaming.chunks import chunked_search, placed, stream_events, stream_search

SCHEMA = "stream string, seq long, text string, reset boolean"
differ = lambda a, b: sum(x != y for x, y in zip(a, b))


def cut(rng, count, letters="abé"):
    """Chunks of some streams, of no character to some dozens, with resets."""
    out = []
    for name in range(count):
        for seq in range(rng.randint(1, 30)):
            text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 1, 2, 7, 30])))
            out.append((f"s{name}", seq, rng.choice([text, text, None]), rng.choice([None, False, False, False, True])))
    return out


def texts_of(chunks):
    texts, era = {}, {}
    for stream, _, text, reset in sorted(chunks, key=lambda c: c[:2]):
        era[stream] = era.get(stream, 0) + bool(reset)
        texts[stream, era[stream]] = texts.get((stream, era[stream]), "") + (text or "")
    return texts


def brute(chunks, patterns, k, circular=False):
    out = []
    for (stream, era), text in texts_of(chunks).items():
        for p, x in enumerate(patterns):
            for i in range(len(text) - len(x) + 1):
                d = min((differ(x[r:] + x[:r], text[i : i + len(x)]), r) for r in range(len(x) if circular else 1))
                if d[0] <= k:
                    out.append((stream, era, p, i, *d) if circular else (stream, era, p, i, d[0]))
    return sorted(out)


@pytest.mark.parametrize("circular", [False, True])
def test_chunks_equal_whole_texts_however_they_are_cut(spark, monkeypatch, circular):
    monkeypatch.setattr(module, "PIECE", 16)
    monkeypatch.setattr(module, "SPAN", 4)
    chunks, patterns = cut(random.Random(3), 12), ["ab", "abébaa", "aab" * 5]
    rows = spark.createDataFrame([(*c, 1) for c in chunks], SCHEMA + ", era int")
    names = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    for k in (0, 2):
        assert sorted(map(tuple, chunked_search(rows, names, k, circular=circular).collect())) == brute(chunks, patterns, k, circular) != []
    # No piece is longer than it must be, and what is placed is all there is.
    assert sum(len(c[2] or "") for c in chunks) == placed(rows).selectExpr("sum(length(text))").first()[0]
    with pytest.raises(ValueError):
        chunked_search(rows, names, 1, longest=14)
    assert chunked_search(rows, names.limit(0), 1).count() == chunked_search(rows.limit(0), names, 1).count() == 0


def run(spark, tmp_path, parts, patterns, k, schema=SCHEMA, name="found", watermark=None, **options):
    """Events of a stream whose batches are `parts`; a further call with the same folder goes on from its checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    source = source if watermark is None else source.withWatermark("time", watermark)
    events = stream_events(source, patterns, k, **options)
    query = events.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    rows = spark.read.schema(events.schema).parquet(f"{tmp_path}/{name}").collect()
    kind = lambda name: sorted((r for r in map(tuple, rows) if r[0] == name), key=str)
    return kind("match"), kind("gap"), kind("left"), query


@pytest.mark.parametrize("circular", [False, True])
def test_replay_equals_batch(spark, tmp_path, circular):
    rng = random.Random(5)
    chunks, patterns = cut(rng, 4), ["ab", "abébaa"]
    order = chunks[:]
    rng.shuffle(order)
    parts = [order[i::3] for i in range(3)] + [chunks[:9]]
    found, gaps, left, _ = run(spark, tmp_path, parts, list(enumerate(patterns)), 1, circular=circular)
    take = (1, 3, 4, 5, 6, 7) if circular else (1, 3, 4, 5, 6)
    assert sorted(tuple(r[i] for i in take) for r in found) == brute(chunks, patterns, 1, circular) != []
    # What came twice is listed, and matches nothing again.
    assert gaps == [] and sorted((r[1], r[2]) for r in left) == sorted((c[0], c[1]) for c in chunks[:9])


def test_a_lost_chunk_neither_blocks_a_stream_nor_lets_it_grow(spark, tmp_path):
    lost = [("s", 0, "xxab", None), *(("s", i, "ab", None) for i in range(2, 9)), ("t", 0, "ab", None)]
    found, gaps, left, query = run(spark, tmp_path, [lost[:4], lost[4:], [("s", 1, "ab", None), ("s", 9, "aab", None)]], [(7, "ab"), (8, "abab"), (9, None), (10, "")], 0, waiting=3)
    # Chunks 2 to 4 wait; with a fourth, chunk 1 is given up, and the text begins anew in another era.
    assert gaps == [("gap", "s", 1, 0, None, 1, None, None)]
    assert left == [("left", "s", 1, 1, None, None, None, None)]
    text = "ab" * 7 + "aab"
    want = {("s", 0, 7, 2), ("t", 0, 7, 0)} | {("s", 1, p, i) for p, x in ((7, "ab"), (8, "abab")) for i in range(len(text)) if text.startswith(x, i)}
    assert {(r[1], r[3], r[4], r[5]) for r in found} == want and len(found) == len(want)
    # Two streams, and no chunk that waits.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_event_time_ends_gaps_and_idle_streams(spark, tmp_path):
    schema, start = SCHEMA + ", time timestamp", datetime(2024, 1, 1)
    at = lambda stream, seq, text, seconds: (stream, seq, text, None, start + timedelta(seconds=seconds))
    parts = [[at("s", 0, "ca", 0), at("s", 2, "bc", 5), at("o", 0, "x", 0)], [at("o", 1, "x", 40)], [at("o", 2, "x", 41)], [at("s", 3, "ab", 42), at("s", 1, "b", 43)], [at("o", 3, "x", 300)], [at("o", 4, "x", 301)], [at("s", 0, "cab", 302)]]
    found, gaps, left, _ = run(spark, tmp_path, parts, [(1, "bcab"), (2, "cab")], 0, schema=schema, watermark="1 second", gap_seconds=20, idle_seconds=100, time_col="time")
    assert gaps == [("gap", "s", 1, 0, None, 1, None, None)]
    assert left == [("left", "s", 1, 1, None, None, None, None)]
    # Behind the gap the text is bcab; after the stream was idle it begins again with chunk 0.
    assert [(r[2], r[3], r[4], r[5]) for r in found] == [(0, 0, 2, 0), (3, 1, 1, 0), (3, 1, 2, 1)] or sorted((r[2], r[3], r[4], r[5]) for r in found) == [(0, 0, 2, 0), (3, 1, 1, 0), (3, 1, 2, 1)]


def test_patterns_may_change_at_a_restart(spark, tmp_path):
    run(spark, tmp_path, [[("s", 0, "xxabc", None)]], [(1, "abcd")], 0, longest=8)
    found, *_ = run(spark, tmp_path, [[("s", 1, "defgh", None)]], [(2, "bcdefg"), (1, "abcd"), (3, "xab")], 0, longest=8)
    # Matches that end in the new chunk, of old and new patterns; xab ended before.
    assert [(r[2], r[4], r[5]) for r in found] == [(1, 1, 2), (1, 2, 3)]


def test_arguments(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    for wrong in ({"longest": 1}, {"waiting": -1}):
        with pytest.raises(ValueError):
            stream_events(stream, [(1, "ab")], 0, **wrong)
    name, before = module._STORE[0], spark.conf.get(module._STORE[0])
    spark.conf.unset(name)
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            stream_search(stream, [(1, "ab")], 0)
    finally:
        spark.conf.set(name, before)
