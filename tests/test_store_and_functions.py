"""Versions of a saved store, and the table function over a table's rows."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from motifspark.functions import table_functions
from motifspark.operators import store

rows = lambda df: sorted(map(tuple, df.collect()))


def test_a_store_is_written_back_to_where_it_was_loaded(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = spark.createDataFrame([("ab", 1), ("abc", 2), ("b", 3)], "key string, value long")
    new = spark.createDataFrame([("ab", 7), ("c", 9)], "key string, value long")
    with pytest.raises(ValueError):
        store.load(spark, path)
    assert store.save(first, path) == 0
    before = store.load(spark, path)
    assert store.save(store.store_all(store.load(spark, path), new), path) == 1
    assert rows(store.load(spark, path)) == [("ab", 7), ("abc", 2), ("b", 3), ("c", 9)]
    # Readers of the version before still have it; it goes with the one after the next.
    assert rows(before) == rows(store.load(spark, path, 0)) == rows(first)
    store.save(store.delete(store.load(spark, path), new), path)
    assert store.versions(spark, path) == [1, 2] and rows(store.load(spark, path)) == [("abc", 2), ("b", 3)]
    assert len(list((tmp_path / "store" / "data").iterdir())) == 2
    with pytest.raises(ValueError):
        store.load(spark, path, 0)


def test_a_failed_save_leaves_the_store_readable(spark, tmp_path):
    path = f"{tmp_path}/store"
    kept = spark.createDataFrame([("ab", 1)], "key string, value long")
    store.save(kept, path)
    broken = store.load(spark, path).withColumn("value", F.when(F.col("key") == "ab", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.save(broken, path)
    assert store.versions(spark, path) == [0] and rows(store.load(spark, path)) == [("ab", 1)]
    # Two savers at once: the second finds the version there.
    (tmp_path / "store" / "log" / "000000000001").write_text("data/other")
    versions = store.versions
    store.versions = lambda *a: [0]
    try:
        with pytest.raises(Exception, match="exist"):
            store.save(kept, path)
    finally:
        store.versions = versions


def test_files_of_a_saved_store_are_ranges_of_keys(spark, tmp_path):
    path = f"{tmp_path}/store"
    keys = spark.range(5000).select(F.lpad(F.conv((F.col("id") * 7919) % 65536, 10, 16), 4, "0").alias("key"), F.col("id").alias("value"))
    store.save(keys, path)
    kept = store.load(spark, path)
    files = sorted(map(tuple, kept.groupBy(F.input_file_name()).agg(F.min("key"), F.max("key")).drop("input_file_name()").collect()))
    assert all(a[1] < b[0] for a, b in zip(files, files[1:]))
    walked = store.walk(kept, "AB")
    assert "StringStartsWith(key,AB)" in walked._jdf.queryExecution().executedPlan().toString()
    assert sum(r["keys"] for r in walked.collect()) == keys.where("key LIKE 'AB_%'").count()


def test_table_function_over_a_table(spark, monkeypatch):
    table_functions.register(spark)
    spark.createDataFrame([(1, "abcabd"), (2, "xxabx"), (3, None), (4, "")], "id int, text string").createOrReplaceTempView("texts")
    found = spark.sql("SELECT * FROM kmismatch_table(TABLE(texts), array('abc', NULL, 'x'), 1)")
    assert found.columns == ["id", "text", "pattern", "pos", "distance"]
    want = [(i, t, p, s, sum(a != b for a, b in zip(x, t[s:]))) for i, t in ((1, "abcabd"), (2, "xxabx")) for p, x in ((0, "abc"), (2, "x")) for s in range(len(t) - len(x) + 1)]
    assert rows(found) == sorted(w for w in want if w[4] <= 1)
    parts = spark.sql("SELECT id, pos FROM kmismatch_table(TABLE(texts) PARTITION BY (id), array('ab'), 0)")
    assert rows(parts) == [(1, 0), (1, 3), (2, 2)]
    for wrong in ("TABLE(SELECT 1 AS x), array('a'), 0", "TABLE(SELECT 'a' AS text, 1 AS pos), array('a'), 0", "TABLE(texts), array('a'), -1"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM kmismatch_table({wrong})").collect()
    # Patterns are prepared once for all rows.
    table_functions._prepared.cache_clear()
    for _ in range(5):
        assert list(table_functions.KMismatchTable().eval(Row(text="abc"), ["a"], 0)) == [("abc", 0, 0, 0)]
    assert table_functions._prepared.cache_info().misses == 1
