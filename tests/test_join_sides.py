"""Tables that grow with the texts are no side of a join that is broadcast, however small their files are."""

import pytest

from motifspark.operators import index, tables
from motifspark.operators.corpus_index import CorpusIndex

TEXTS = [(i, t) for i, t in enumerate(["banana", "ananas", "", "aaaa", None, "b"])]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "text_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_index(spark, texts, monkeypatch):
    few = CorpusIndex(texts)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    many = CorpusIndex(texts)
    assert "Broadcast" not in plan(many.lcp_array())
    assert sorted(many.lcp_array().collect()) == sorted(few.lcp_array().collect())


def test_labels_are_broadcast_by_their_rows(spark, monkeypatch):
    rows, labels = (tables.written(spark.range(n)) for n in (50, 20))
    assert "BroadcastHashJoin" in plan(rows.join(tables.joinable(labels), "id"))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    assert "SortMergeJoin" in plan(rows.join(tables.joinable(labels), "id"))


def test_range_minimum(spark, texts):
    suffixes = tables.written(index.suffix_array(texts))
    ranges = spark.createDataFrame([(0, 1, 4), (1, 0, 5), (0, 3, 2)], "text_id long, low int, high int")
    found = index.range_minimum(index.lcp_array(suffixes), tables.written(ranges), 6)
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 4, 0), (0, 3, 2, None), (1, 0, 5, 0)]


def test_common_extension(spark, texts):
    suffixes = tables.written(index.suffix_array(texts))
    pairs = spark.createDataFrame([(0, 1, 3), (1, 0, 2), (1, 4, 4), (3, 0, 9)], "text_id long, i int, j int")
    found = index.common_extension(suffixes, tables.written(pairs), 6)
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 3, 3), (1, 0, 2, 3), (1, 4, 4, 2), (3, 0, 9, 0)]
