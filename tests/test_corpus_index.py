"""The index of a whole corpus equals sorted suffixes; its plans have no Python."""

import random

from motifspark.operators.corpus_index import CorpusIndex, numbered

agree = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffixes_prefixes_and_extensions_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé\U0001f600￮") for _ in range(n)) for n in (1, 2, 9, 33)] + ["a" * 17, "abab" * 4, "abab" * 4, "", None]
    index = CorpusIndex(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"))
    suffixes = sorted(((t or "")[i:], n, i) for n, t in enumerate(texts) for i in range(len(t or "")))
    array = index.suffix_array()
    assert sorted((r["rank"], r.text_id, r.pos) for r in array.collect()) == [(k, n, i) for k, (_, n, i) in enumerate(suffixes)]
    lcp = index.lcp_array()
    want = [(k, n, i, agree(s, suffixes[k - 1][0]) if k else 0) for k, (s, n, i) in enumerate(suffixes)]
    assert sorted((r["rank"], r.text_id, r.pos, r.lcp) for r in lcp.collect()) == want
    assert "Python" not in lcp._jdf.queryExecution().toString() and "ArrowEval" not in lcp._jdf.queryExecution().toString()
    numbers = {r.text_id: r.t for r in index.texts.collect()}
    asked = [(numbers[a], i, numbers[b], j, a, b) for a in numbers for b in numbers for i in (0, 3, 8) for j in (0, 1, 40)] + [(numbers[0], None, numbers[1], 0, 0, 1)]
    for r in index.common_extension(spark.createDataFrame(asked, "t long, i int, u long, j int, a long, b long")).collect():
        assert r.lce == (None if r.i is None else agree(texts[r.a][r.i :], texts[r.b][r.j :]))


def test_no_texts_and_numbers(spark):
    index = CorpusIndex(spark.createDataFrame([(1, None), (2, "")], "text_id long, text string"))
    assert index.suffix_array().count() == index.lcp_array().count() == 0
    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id % 3 AS y").repartition(5), ["x"], "n")
    assert all(r.x == r.n for r in rows.collect())
