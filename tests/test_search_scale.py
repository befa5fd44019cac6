"""Ranges of long texts, joined patterns, early stops, thresholds of patterns, bytes and arrays, memory and jumps."""

import random
import time

import numpy as np
import pytest

from motifspark.operators import search, seed_join
from motifspark.operators.search import Patterns, codes, kmismatch, multi_pattern_scan

differ = lambda a, b: sum(x != y for x, y in zip(a, b))


def brute(texts, patterns, ks, circular):
    out = []
    for t, text in enumerate(texts):
        for p, (x, k) in enumerate(zip(patterns, ks)):
            if not x or text is None or k is None:
                continue
            for i in range(len(text) - len(x) + 1):
                w = text[i : i + len(x)]
                d = min((differ(x[r:] + x[:r], w), r) for r in range(len(x) if circular else 1))
                if d[0] <= k:
                    out.append((t, p, i, *d) if circular else (t, p, i, d[0]))
    return sorted(out)


def frames(spark, texts, patterns, kind="string"):
    return spark.createDataFrame(list(enumerate(texts)), f"text_id long, text {kind}"), spark.createDataFrame(list(enumerate(patterns)), f"pattern_id long, pattern {kind}")


def rows(df):
    return sorted(map(tuple, df.collect()))


def some(seed, letters="abé😀", texts=20, patterns=12, longest=16):
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    return [pick(90) for _ in range(texts)] + [None, ""], [pick(longest) for _ in range(patterns)] + ["", None]


@pytest.mark.parametrize("circular", [False, True])
@pytest.mark.parametrize("options", [{"range_size": 7}, {"range_size": 33, "block_size": 16}, {"strategy": "join"}, {"range_size": 11, "strategy": "scan"}])
def test_ranges_and_joins_equal_brute_force(spark, monkeypatch, circular, options):
    monkeypatch.setattr(seed_join, "RANGE", 20)
    texts, patterns = some(1)
    for k in (0, 2):
        want = brute(texts, patterns, [k] * len(patterns), circular)
        found = kmismatch(*frames(spark, texts, patterns), k, circular=circular, **options)
        assert rows(found) == want and want
        assert found.columns == ["text_id", "pattern_id", "pos", "distance", "rotation"][: 5 if circular else 4]


def test_joined_patterns_of_repeated_and_null_ids(spark):
    texts, patterns = frames(spark, ["abcabd" * 5, "xabx"], ["abd", "ab", "ab", "z"])
    twice = patterns.withColumn("pattern_id", patterns.pattern_id % 2).union(patterns.selectExpr("NULL", "pattern"))
    texts = texts.union(texts.selectExpr("NULL", "text"))
    found = lambda **how: sorted(map(tuple, kmismatch(texts, twice, 1, **how).collect()), key=str)
    assert found(strategy="join") == found() != []
    none = patterns.where("pattern_id > 99")
    assert kmismatch(texts, none, 1, strategy="join").count() == kmismatch(texts.where("1 = 0"), patterns, 1, strategy="join").count() == 0


def test_large_pattern_tables_are_joined_and_never_collected(spark, monkeypatch):
    monkeypatch.setattr(search, "PATTERN_CHARS", 100)
    texts, patterns = some(3, patterns=60)
    a, b = frames(spark, texts, patterns)
    want, collected = brute(texts, patterns, [1] * len(patterns), False), []
    monkeypatch.setattr(type(b), "toArrow", lambda self, f=type(b).toArrow: collected.append(self.columns) or f(self))
    found = kmismatch(a, b, 1)
    # The filter's words, and the patterns of one character, which match everywhere.
    assert all(c == ["word", "bits"] or c == ["pattern_id", "pattern", "k"] for c in collected)
    assert rows(found) == want
    short = {p for p, x in enumerate(patterns) if x and len(x) <= 1}
    assert {p for _, p, _, _ in want} > short


def test_thresholds_of_each_pattern(spark):
    texts, patterns = some(5)
    ks = [(0, 1, 3, None)[i % 4] for i in range(len(patterns))]
    a, _ = frames(spark, texts, [])
    b = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(zip(patterns, ks))], "pattern_id long, pattern string, k int")
    for circular in (False, True):
        want = brute(texts, patterns, ks, circular)
        for strategy in ("seeds", "scan", "join"):
            assert rows(kmismatch(a, b, None, circular=circular, strategy=strategy)) == want
        three = [r for k in (0, 1, 3) for r in rows(kmismatch(a, b.where(f"k = {k}"), k, circular=circular))]
        assert sorted(three) == want
    with pytest.raises(ValueError):
        kmismatch(a, b.withColumn("k", -b.k), None)


@pytest.mark.parametrize("strategy", ["seeds", "scan", "join"])
def test_bytes_and_arrays_equal_strings(spark, strategy):
    texts, patterns = some(7, letters="abéß")
    code = lambda x: None if x is None else bytes(x, "latin-1")
    want = rows(kmismatch(*frames(spark, texts, patterns), 1, circular=True, strategy=strategy))
    assert rows(kmismatch(*frames(spark, list(map(code, texts)), list(map(code, patterns)), "binary"), 1, circular=True, strategy=strategy)) == want
    # Any bytes, those of no text in UTF-8 included; an é there is two symbols.
    raw = frames(spark, [b"\xff\x00\xc3\xa9\x80", "é".encode()], [b"\xa9", b"\x00\xc3\xff"], "binary")
    assert rows(kmismatch(*raw, 1, strategy=strategy)) == [(0, 0, i, int(i != 3)) for i in range(5)] + [(0, 1, 1, 1), (1, 0, 0, 1), (1, 0, 1, 0)]
    listed = lambda x: None if x is None else [ord(c) * 10**12 for c in x]
    assert rows(kmismatch(*frames(spark, list(map(listed, texts)), list(map(listed, patterns)), "array<long>"), 1, circular=True, strategy=strategy)) == want


def test_symbols_of_arrays(spark):
    texts, patterns = frames(spark, [["new", "york", None, "city"], ["york", "york"], [], None], [["york"], [None], ["york", "other"], []], "array<string>")
    assert rows(kmismatch(texts, patterns, 0)) == [(0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 1, 0)]
    assert rows(kmismatch(texts, patterns.where("pattern_id = 2"), 1)) == [(0, 2, 1, 1), (1, 2, 0, 1)]
    with pytest.raises(ValueError):
        kmismatch(texts, frames(spark, [], ["a"])[1], 0)


def test_first_matches_of_each_text(spark):
    texts, patterns = some(9, texts=30)
    a, b = frames(spark, texts, patterns)
    every = brute(texts, patterns, [1] * len(patterns), False)
    scanned = rows(multi_pattern_scan(a, b))
    for stop in (1, 3):
        first = lambda found, at: sorted(r for r in found if len({x[at] for x in found if x[0] == r[0] and x[at] < r[at]}) < stop)
        for size in (1 << 21, 13):
            assert rows(kmismatch(a, b, 1, stop_after=stop, range_size=size)) == first(every, 2)
            assert rows(multi_pattern_scan(a, b, stop_after=stop, range_size=size)) == first(scanned, 3)
    with pytest.raises(ValueError):
        kmismatch(a, b, 1, stop_after=0)
    with pytest.raises(ValueError):
        kmismatch(a, b, 1, stop_after=1, strategy="join")


def test_texts_are_read_no_further_than_their_first_matches():
    rng = random.Random(2)
    text = "".join(rng.choice("xyz") for _ in range(1_000_000))
    hit = [text[:300] + "needle" + text[306:], text, "needle" + text[6:]]
    ends = np.cumsum([len(t) for t in hit])
    wanted = Patterns(["needle", "haystack"], 0)
    (_, start, _, _), looked = wanted.first(codes("".join(hit)), ends, 1 << 18, 1, True)
    assert sorted(start.tolist()) == [300, 2_000_000]
    # The text without a match is read whole; of the others some hundreds of starts each.
    assert len(text) <= looked < len(text) + 5000
    # A shorter pattern may end before a longer one that starts first.
    (number, start, _, _), _ = Patterns(["abcdefgh", "d"], 0).first(codes("xabcdefghd"), np.array([10]), 2, 1, True)
    assert (number.tolist(), start.tolist()) == ([1], [4])


def test_a_long_text_is_the_work_of_many_tasks(spark):
    rng = np.random.default_rng(4)
    text = bytearray(rng.choice(np.frombuffer(b"acgt", np.uint8), 3_000_000).tobytes())
    size, word = 200_000, b"tacocattacocat"
    places = [i * size - j for i in range(1, 15) for j in (0, 1, 7, 13, 14)][::3]
    for p in places:
        text[p : p + len(word)] = word
    texts, patterns = frames(spark, [text.decode()], [word.decode()])
    found = kmismatch(texts, patterns, 1, range_size=size)
    assert {r[2] for r in rows(found)} >= set(places) and len(rows(found)) == len(set(rows(found)))
    assert found.withColumn("part", search.F.spark_partition_id()).select("part").distinct().count() > 1
    assert rows(found) == rows(kmismatch(texts, patterns, 1))


def test_hits_of_short_seeds_are_held_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    held = []
    monkeypatch.setattr(search, "HITS", 1 << 14)
    compared = Patterns._compared
    monkeypatch.setattr(Patterns, "_compared", lambda self, number, *rest: held.append(len(number)) or compared(self, number, *rest))
    found = list(Patterns(texts, 3).search(codes(text), np.array([len(text)]), 1 << 18))
    pairs = sorted((n, s) for number, start, *_ in found for n, s in zip(number.tolist(), start.tolist()))
    assert max(held) <= 1 << 14 and len(pairs) == len(set(pairs))
    sample = set(range(0, len(text) - 7, 97))
    assert [x for x in pairs if x[1] in sample] == sorted((p, i) for p, x in enumerate(texts) for i in sample if differ(x, text[i : i + 7]) <= 3)


@pytest.mark.parametrize("circular", [False, True])
def test_long_patterns_equal_brute_force(circular):
    rng = random.Random(8)
    base = "".join(rng.choice("ab") for _ in range(700))
    swap = lambda t, *at: "".join("#" if i in at else x for i, x in enumerate(t))
    patterns, ks = [base[:300], base[100:420], "ab" * 150], [2, 3, 1]
    texts = [swap(base, 5, 150, 290), base[200:] + swap(base, 120, 130, 140, 150) + "b", "ba" * 400, swap("ab" * 200, 170), base[60:300] + base[:60]]
    wanted = Patterns(patterns, ks, circular)
    ends = np.cumsum([len(t) for t in texts])
    out = []
    for block in (1 << 18, 320):
        found = [x for part in wanted.search(codes("".join(texts)), ends, block) for x in zip(*(c.tolist() for c in part))]
        begins = [0, *ends[:-1].tolist()]
        text_of = lambda s: int(np.searchsorted(ends, s, "right"))
        out.append(sorted((text_of(s), n, s - begins[text_of(s)], d, *([r] if circular else [])) for n, s, d, r in found))
    assert out[0] == out[1] == brute(texts, patterns, ks, circular) != []


def test_candidates_of_long_patterns_cost_no_more_than_those_of_short_ones():
    rng = np.random.default_rng(3)
    seconds = {}
    for m in (2_000, 100_000):
        # Each text holds the pattern's pieces in the wrong order, so that there are candidates, and no match.
        pattern = "".join(map(chr, rng.integers(97, 101, m)))
        piece = m // 4
        text = "".join(pattern[i * piece : (i + 1) * piece] + "".join(map(chr, rng.integers(97, 101, 50))) for i in (3, 1, 0, 2) * 3)
        wanted, points = Patterns([pattern], 3), codes(text)
        compared = []
        wanted._compared = lambda number, at, *rest, f=wanted._compared: compared.append(len(number)) or f(number, at, *rest)
        list(wanted.search(points, np.array([len(points)]), 1 << 20))
        assert sum(compared) == 0
        sums = search.Hasher.sums(points)
        _, found = wanted._hits(sums)
        hits = [(np.repeat(p, c), o[np.arange(c.sum()) + np.repeat(left - np.cumsum(c) + c, c)], s) for s, p, left, c, _, o in found]
        places, offs, size = hits[0]
        times = []
        for _ in range(3):
            began = time.perf_counter()
            wanted._promising(sums, np.zeros(2000, np.int64), np.resize(places, 2000), np.resize(offs, 2000), size, np.array([len(points)]))
            times.append(time.perf_counter() - began)
        seconds[m] = min(times)
    # Binary searches over fifty times the length take some more steps, not fifty times the time.
    assert seconds[100_000] < 5 * seconds[2_000]


def test_arguments(spark):
    a, b = frames(spark, ["abc"], ["ab"])
    for wrong in ({"range_size": 0}, {"strategy": "guess"}, {"k": -1}):
        with pytest.raises(ValueError):
            kmismatch(a, b, **({"k": 1} | wrong))


def test_seed_join_works_on_many_texts_at_once():
    import pyarrow as pa

    from motifspark.operators.search import ranges
    from motifspark.operators.seed_join import _text_seeds

    class Rows:
        """Stands for a DataFrame: keeps the function that maps its batches."""

        def __init__(self):
            self.schema, self.sparkSession = [], self
            self.sparkContext = self

        select = lambda self, *_: self
        broadcast = lambda self, value: type("Shared", (), {"value": value})
        mapInArrow = lambda self, run, kinds: run

    batch = pa.RecordBatch.from_pydict({"t": list(range(900)), "text": ["abcdefgh"] * 900})
    cut = list(ranges(Rows(), 4, 3, [])([batch]))
    assert len(cut) == 1 and cut[0].num_rows == 1800
    pieces = pa.RecordBatch.from_pydict({"t": list(range(900)), "base": [0] * 900, "owned": [8] * 900, "text": ["abcdefgh"] * 900})
    found = list(_text_seeds(Rows(), [4], np.full(1 << 22, 255, np.uint8))([pieces]))
    assert len(found) == 1 and found[0].num_rows == 900 * 5 and set(found[0]["pos"].to_pylist()) == set(range(5))


@pytest.mark.parametrize("circular", [False, True])
def test_seed_join_searches_equal_texts_once(spark, monkeypatch, circular):
    compared, own = [], seed_join._text_seeds
    monkeypatch.setattr(seed_join, "_text_seeds", lambda pieces, *how: (compared.append(pieces.count()), own(pieces, *how))[1])
    texts, patterns = ["abcabd", "xabx"] * 40 + ["abab", None, ""], ["abd", "abx", "bca"]
    want = brute(texts, patterns, [1] * 3, circular)
    # The two repeated texts are dealt out, or none is.
    for hot in (10, 1):
        monkeypatch.setattr(seed_join, "HOT", hot)
        assert rows(kmismatch(*frames(spark, texts, patterns), 1, circular=circular, strategy="join")) == want and want
    assert compared == [3, 3]
