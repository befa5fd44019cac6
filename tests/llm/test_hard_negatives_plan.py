"""Copies of the anchors' blocks are shuffled, never broadcast."""

from motifspark.llm.hard_negatives import mine


def test_no_broadcast(spark):
    rows = [(i, [float((i * j) % 7 - 3) / 8 for j in range(1, 5)], i % 3) for i in range(60)]
    found = mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "id % 10 = 0")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0
