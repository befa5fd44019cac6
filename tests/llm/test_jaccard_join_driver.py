"""What grows with the texts is shuffled by the n-gram Jaccard join, however small its files are."""

from motifspark.llm import common, jaccard_join

WORDS = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
DOCS = [(i, " ".join(WORDS[: 26 - i % 3] + [str(i // 6)] * (i % 2))) for i in range(24)] + [(90, None), (91, "x")]


def test_no_broadcast_of_tables_that_grow(spark, monkeypatch):
    plans, own = [], common.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    with_pivots = sorted(jaccard_join.jaccard_join(docs).collect())
    monkeypatch.setattr(common, "cut", seen)
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    found = jaccard_join.jaccard_join(docs)
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)
    assert sorted(found.collect()) == with_pivots
    # The last joins broadcast the keys that very many rows have, which are few, and nothing else.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 2
