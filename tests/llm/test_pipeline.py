import random

import corpus_pipeline

FAULT = " ".join("w%%%" for _ in range(60))


def text(i, n=60):
    return " ".join(f"word{(i * 7919 + j * 104729) % 9973}x" for j in range(n))


def test_stages_take_effect(spark, tmp_path):
    passage = text(900, 12)
    texts = {1: text(1), 2: text(1), 3: text(3) + " " + passage + " tail", 4: text(4) + " token = " + "0123456789abcdef" * 2, 5: FAULT, 6: text(6), 7: "", 8: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{number}")
        kept = spark.read.parquet(f"{tmp_path}/stage{number}")
    ids = lambda n: {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/stage{n}").collect()}
    assert ids(0) == {1, 2, 3, 4, 6}
    assert ids(1) == ids(2) == ids(3) == ids(4) == {1, 3, 4, 6}
    final = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    assert final[1] == texts[1] and final[6] == texts[6]
    assert passage not in final[3] and final[3].endswith("tail")
    assert final[4].endswith("[SECRET]")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_near_copies_between_the_limits_go(spark):
    def similar(a, b, size):
        a, b = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    words = text(1, 52).split()
    near = " ".join(words[:26] + ["other"] + words[27:])
    far = " ".join(words[:12] + ["other"] + words[13:38] + ["another"] + words[39:])
    assert similar(text(1, 52), near, 4) < 0.85 and similar(text(1, 52), near, 5) >= 0.8
    assert max(similar(a, far, 5) for a in (text(1, 52), near)) < 0.8
    docs = spark.createDataFrame([(1, text(1, 52)), (2, near), (3, far)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()} == {1, 3}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(5):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 30, 90]))]
        for _ in range(20):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()} == set(group)


def test_rows_of_null_and_repeated_ids(spark):
    rows = [(3, text(3)), (5, text(5)), (5, text(3)), (5, text(6)), (None, text(7)), (None, text(8)), (None, text(8)), (None, text(6)), (9, text(7)), (None, None), (4, text(3)), (4, "")]
    want = [(3, text(3)), (5, text(5)), (5, text(6)), (9, text(7)), (None, text(8)), (None, None), (4, "")]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string")
        assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, None).collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_of_exploded_rows_and_clashing_names(spark, tmp_path):
    rows = [(1, text(1), 7, "x", 0, "m"), (2, text(2), 8, "y", 1, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, _row int, id string, row int, _metadata string").write.parquet(f"{tmp_path}/clash.parquet")
    docs = spark.read.parquet(f"{tmp_path}/clash.parquet")
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, None).collect())) == rows
    # Two copies made from one row of a file are two rows.
    plain = spark.read.parquet(f"{tmp_path}/clash.parquet").drop("_metadata")
    twice = plain.selectExpr("*", "explode(array(1, 2)) AS copy")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, twice, None).collect()) == [1, 2]
    assert corpus_pipeline.near_duplicates(spark, plain.limit(0), None).count() == 0
