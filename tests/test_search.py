import random

import pytest

from motifspark.operators import hamming, index, prepare, shaping, store
from motifspark.operators.search import kmismatch, multi_pattern_scan
from motifspark.plans import catalog
from motifspark.sources import files
from motifspark.streaming.chunks import chunked_search, stream_search

FIXTURES = [
    ("GATACGATACCTAGGGTGATAGAATAG", "GGGTCTA", 3, [13, 14], [1, 2, 7, 8, 9, 10, 11, 12, 13, 14, 15, 18, 19, 20]),
    ("CATATAGATAGATCCCAATAGAGT", "ATGGTGTCCCA", 4, [], [8, 9, 10, 11, 12, 13]),
    ("GGGTCTAGATCAAAT", "AGCTC", 2, [0, 6], [0, 1, 5, 6, 7, 8, 9, 10]),
    ("GTCACG", "ACAC", 1, [1], [1, 2]),
    ("GA", "AA", 0, [], []),
    ("ABC", "XY", 2, [0, 1], [0, 1]),
    ("AB", "ABC", 0, [], []),
    ("CDABX", "ABCD", 0, [], [0]),
]


def frames(spark, texts, patterns):
    return spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")


@pytest.mark.parametrize("text,pattern,k,linear,circular", FIXTURES)
def test_fixtures(spark, text, pattern, k, linear, circular):
    texts, patterns = frames(spark, [text, None, ""], [pattern, None, ""])
    assert sorted(r.pos for r in kmismatch(texts, patterns, k).collect()) == linear
    for strategy in ("seeds", "scan"):
        assert sorted(r.pos for r in kmismatch(texts, patterns, k, circular=True, block_size=11, strategy=strategy).collect()) == circular


@pytest.mark.parametrize("k", [0, 1, 3])
def test_random_equal_brute_force(spark, k):
    rng = random.Random(k)
    pick = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(1, n)))
    texts, patterns = [pick(60) for _ in range(25)], [pick(14) for _ in range(12)]
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    linear, circular = [], []
    for t, text in enumerate(texts):
        for p, x in enumerate(patterns):
            for i in range(len(text) - len(x) + 1):
                w = text[i : i + len(x)]
                d = min((differ(x[r:] + x[:r], w), r) for r in range(len(x)))
                if differ(x, w) <= k:
                    linear.append((t, p, i, differ(x, w)))
                if d[0] <= k:
                    circular.append((t, p, i, *d))
    a, b = frames(spark, texts, patterns)
    for size, strategy in ((14, "seeds"), (17, "scan"), (512, "seeds")):
        assert sorted(map(tuple, kmismatch(a, b, k, block_size=size, strategy=strategy).collect())) == linear
        assert sorted(map(tuple, kmismatch(a, b, k, circular=True, block_size=size, strategy=strategy).collect())) == circular


def test_arguments_and_groups(spark, monkeypatch):
    texts, patterns = frames(spark, ["abcabd" * 3, None], ["abd", "bca", "cab", "xyz"])
    for wrong in ({"k": -1}, {"k": 1, "block_size": 2}, {"k": 1, "strategy": "guess"}):
        with pytest.raises(ValueError):
            kmismatch(texts, patterns, **wrong)
    want = sorted(map(tuple, kmismatch(texts, patterns, 1).collect()))
    monkeypatch.setattr("motifspark.operators.search.PATTERN_CHARS", 20)
    assert sorted(map(tuple, kmismatch(texts, patterns, 1).collect())) == want and want
    none = patterns.where("pattern_id < 0")
    assert kmismatch(texts, none, 1).count() == kmismatch(texts.where("text_id < 0"), patterns, 1).count() == 0
    clash = texts.withColumns({"pos": texts.text_id, "pattern": texts.text, "distance": texts.text_id})
    assert sorted(map(tuple, kmismatch(clash, patterns, 1).collect())) == want
    twice = texts.union(texts).withColumn("text_id", texts.text_id * 0)
    assert kmismatch(twice, patterns, 1).count() == 2 * len(want)


def test_no_shuffle_in_a_search(spark):
    texts, patterns = frames(spark, ["abc"] * 50, ["ab"])
    plan = kmismatch(texts.repartition(8), patterns, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_preparation_and_index(spark):
    texts, patterns = frames(spark, ["banana", None], ["abab", None, "abab", ""])
    pieces = prepare.fragments(patterns, 2)
    assert sorted(map(tuple, pieces.collect())) == [(0, 0, 0, "ab"), (0, 1, 2, "ab"), (2, 0, 0, "ab"), (2, 1, 2, "ab")]
    assert {r.first_equal for r in prepare.equal_fragments(pieces).collect()} == {0}
    assert {r.pattern_id: r.status for r in prepare.pattern_status(patterns).collect()} == {0: "ok", 1: "empty", 2: "duplicate", 3: "empty"}
    assert [r.z for r in index.prefix_array(frames(spark, ["aabaa"], [])[0]).orderBy("pos").collect()] == [0, 1, 0, 2, 1]
    assert [(r.pos, r.lcp) for r in index.suffix_array(texts).orderBy("rank").collect()] == [(5, 0), (3, 1), (1, 3), (0, 0), (4, 0), (2, 2)]
    assert sorted(map(tuple, multi_pattern_scan(texts, frames(spark, [], ["an", "nan"])[1]).collect())) == [(0, 0, 1, 3), (0, 0, 3, 5), (0, 1, 2, 5)]


def test_index_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\u00e9\U0001f600") for _ in range(n)) for n in (1, 2, 9, 40)] + ["a" * 30, "abab" * 8]
    agree = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    texts = frames(spark, words, [])[0]
    rows = {(r.text_id, r.pos): (r["rank"], r.lcp) for r in index.suffix_array(texts).collect()}
    zs = {(r.text_id, r.pos): r.z for r in index.prefix_array(texts).collect()}
    for t, w in enumerate(words):
        order = sorted(range(len(w)), key=lambda i: w[i:])
        for rank, i in enumerate(order):
            assert rows[t, i] == (rank, agree(w[order[rank - 1] :], w[i:]) if rank else 0)
            assert zs[t, i] == (agree(w, w[i:]) if i else 0)
    pairs = spark.createDataFrame([(t, i, j) for t, w in enumerate(words) for i in range(len(w)) for j in range(len(w) + 1)] + [(2, None, 1), (99, 0, 0)], "text_id long, i int, j int")
    for r in index.common_extension(index.suffix_array(texts), pairs, 40).collect():
        want = None if r.i is None else agree(words[r.text_id][r.i :], words[r.text_id][r.j :]) if r.text_id < 99 else 0
        assert r.lce == want


def test_mismatches(spark):
    rows = spark.createDataFrame([("abcd", "abxx"), ("", ""), (None, "a")], "x string, w string")
    found = rows.select(hamming.mismatch_positions("x", "w").alias("p"), hamming.hamming("x", "w").alias("d")).collect()
    assert [(r.p, r.d) for r in found] == [([2, 3], 2), ([], 0), (None, None)]
    assert [r.extension for r in hamming.k_extension(rows, 2).collect()] == [[2, 3, 4], [0, 0, 0], None]
    slide = hamming.sliding_mismatches(spark.createDataFrame([("abc", "bcabc"), (None, None)], "x string, w string"))
    assert [r.distances for r in slide.collect()] == [[3, 3, 3], None]


def test_preparation(spark):
    patterns = frames(spark, [], ["abab", "ab", None, "", "ab"])[1]
    pieces = prepare.fragments(patterns.where("pattern_id < 2"), 2)
    assert {tuple(r) for r in prepare.fragment_counts(pieces).collect()} == {(0, 2, 1), (1, 2, 2)}
    groups = {r.fragment: (r.members, [tuple(p) for p in r.places]) for r in prepare.fragment_groups(pieces).collect()}
    assert groups == {"ab": (2, [(0, 0, 0), (0, 1, 2)]), "a": (1, [(1, 0, 0)]), "b": (1, [(1, 1, 1)])}
    assert [tuple(r) for r in prepare.doubled_patterns(patterns).orderBy("pattern_id").collect()] == [(0, "abababa"), (1, "aba"), (4, "aba")]
    assert {tuple(r) for r in prepare.accepted_patterns(patterns, 3).collect()} == {(1, "ab")}
    assert [r.reversed for r in prepare.reversed_texts(frames(spark, ["a\u00e9b", None], [])[0]).collect()] == ["b\u00e9a", None]
    assert {tuple(r) for r in prepare.trie_edges(patterns).collect()} == {("", "a", "a", 3, 0), ("a", "b", "ab", 3, 2), ("ab", "a", "aba", 1, 0), ("aba", "b", "abab", 1, 1)}


def test_shaping(spark):
    texts, patterns = frames(spark, ["spring", "x", None], ["ring", "ing", "s"])
    found = multi_pattern_scan(texts, patterns)
    assert {(r.text_id, r.end_pos, tuple(r.patterns), r.match_num) for r in shaping.match_events(found).collect()} == {(0, 6, (0, 1), 2), (0, 1, (2,), 1)}
    assert [tuple(r) for r in shaping.first_event(found).collect()] == [(0, 1, 2)]
    near = kmismatch(texts, patterns, 1)
    assert [tuple(r) for r in shaping.ordered(near).collect()] == sorted(map(tuple, near.collect()))
    assert {(r.pattern_id, tuple(r.positions), r.occurrences) for r in shaping.position_lists(near).collect() if r.text_id == 0} >= {(0, (2,), 1)}
    assert {tuple(r) for r in shaping.best_matches(near).collect()} == {(0, 0, 2, 0, 1), (0, 1, 3, 0, 1), (0, 2, 0, 0, 1)}
    assert shaping.appended(("a", near), ("b", near)).where("query = 'b'").count() == near.count()
    assert [r.text_id for r in shaping.texts_with_match(texts, found).collect()] == [0]
    assert sorted(r.text_id for r in shaping.texts_without_match(texts, found).collect()) == [1, 2]


def test_store(spark, tmp_path):
    kept = spark.createDataFrame([("ab", 1), ("abc", 2), ("b", 3)], "key string, value long")
    new = spark.createDataFrame([("ab", 7), ("ab", 8), ("c", 9), (None, 1)], "key string, value long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.store_all(kept, new)) == [("ab", 8), ("abc", 2), ("b", 3), ("c", 9)]
    assert rows(store.store_if_absent(kept, new)) == [("ab", 1), ("abc", 2), ("b", 3), ("c", 9)]
    assert rows(store.delete(kept, new)) == [("abc", 2), ("b", 3)]
    assert rows(store.retrieve(kept, new.select("key").where("key IS NOT NULL").distinct())) == [("ab", 1), ("c", None)]
    assert rows(store.walk(kept, "a")) == [("b", 2, True)] and rows(store.walk(kept, "abc")) == []
    store.save(kept, f"{tmp_path}/store")
    assert [r.key for r in store.enumerate_keys(store.load(spark, f"{tmp_path}/store")).collect()] == ["ab", "abc", "b"]


def test_files_and_table_function(spark, tmp_path):
    for name, data in (("a", "GGGTCTAGATCAAAT\n"), ("b", "no\nline feed"), ("c", "two\n\n"), ("d", "")):
        (tmp_path / name).write_bytes(data.encode())
    found = {r.text_id[-1]: r.text for r in files.read_texts(spark, [f"{tmp_path}/{n}" for n in "abcd"]).collect()}
    assert found == {"a": "GGGTCTAGATCAAAT", "b": "no\nline feed", "c": "two\n"}
    (tmp_path / "p").write_text("AGCTC\n")
    texts, patterns = files.read_texts(spark, f"{tmp_path}/a"), files.read_patterns(spark, f"{tmp_path}/p")
    assert sorted(r.pos for r in kmismatch(texts, patterns, 2).collect()) == [0, 6]
    from motifspark.functions import table_functions

    table_functions.register(spark)
    texts.createOrReplaceTempView("searched")
    assert [tuple(r) for r in spark.sql("SELECT m.pos, m.distance FROM searched, LATERAL kmismatch(text, 'AGCTC', 2) m ORDER BY 1").collect()] == [(0, 2), (6, 1)]
    assert [r.pos for r in spark.sql("SELECT * FROM kmismatch_circular('GGGTCTAGATCAAAT', 'GGGTCTA', 1) ORDER BY pos").collect()] == [0, 1, 2]
    assert spark.sql("SELECT * FROM kmismatch(CAST(NULL AS STRING), 'A', 0)").count() == 0


CHUNKS = [("s", 0, "GATACGATACCTAGG", None), ("s", 1, "", None), ("s", 2, "GT", False), ("s", 3, "GATAGAATAG", None), ("r", 0, "GGGTC", None), ("r", 1, "TA", True), ("r", 2, "GGGTCTA", None), ("n", 0, None, None)]


def test_chunks_equal_whole_texts(spark):
    chunks = spark.createDataFrame(CHUNKS, "stream string, seq long, text string, reset boolean")
    patterns = frames(spark, [], ["GGGTCTA"])[1]
    assert sorted(map(tuple, chunked_search(chunks, patterns, 3, 7).collect())) == [("r", 1, 0, 2, 0), ("s", 0, 0, 13, 3), ("s", 0, 0, 14, 3)]


def test_streamed_chunks_carry_state(spark, tmp_path):
    schema = "stream string, seq long, text string, reset boolean"
    source = tmp_path / "in"
    # Out of turn, and one delivered twice.
    for number, part in enumerate(([CHUNKS[3], CHUNKS[4]], [CHUNKS[0], CHUNKS[0], CHUNKS[5]], [CHUNKS[1], CHUNKS[7]], [CHUNKS[2], CHUNKS[6], CHUNKS[0]])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream_search(stream, [(0, "GGGTCTA"), (1, None)], 3).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("found").collect())) == [("r", 0, 2, 0), ("s", 0, 13, 3), ("s", 0, 14, 3)]


def test_documents_hold_whole_items(spark, tmp_path):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (81, 120, 394)]
    a, b, c = items
    swap = lambda t, *at: "".join("#" if i in at else x for i, x in enumerate(t))
    # Edits late in an item, a prefix alone, three edits, and an item across a block's edge.
    documents = ["x" + a, swap(b, 3, 119) + "y", c[:40] + "z" * 400, swap(a, 1, 40, 80), "w" * 300 + swap(c, 393) + a, c[100:] + swap(c[:100], 5), b[:60], "", None]
    frames(spark, documents, [])[0].toDF("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    frames(spark, [], items)[1].toDF("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    linear, circular = [], []
    for t, text in enumerate(documents):
        for p, x in enumerate(items):
            for i in range(len(text or "") - len(x) + 1):
                w = text[i : i + len(x)]
                d = min((differ(x[r:] + x[:r], w), r) for r in range(len(x)))
                linear += [(t, p, i, differ(x, w))] * (differ(x, w) <= 2)
                circular += [(t, p, i, *d)] * (d[0] <= 2)
    assert sorted(map(tuple, catalog.document_search(spark, str(tmp_path)).collect())) == linear
    assert sorted(map(tuple, catalog.document_search_circular(spark, str(tmp_path)).collect())) == circular
    assert (4, 2, 300, 1) in linear and any(r[0] == 5 for r in circular) and not any(r[0] in (2, 3, 6) for r in linear)
