"""Fragments are grouped by tasks of bounded rows, without a join of them with themselves."""

from motifspark.operators import prepare


def test_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(prepare, "TASK_ROWS", 10)
    names = [(i, w) for i, w in enumerate(["abab", "aaaaaaa", "", None, "xyzxyzx"] * 4)]
    pieces = prepare.fragments(spark.createDataFrame(names, "pattern_id long, pattern string"), 7).cache()
    equal, counts = prepare.equal_fragments(pieces), prepare.fragment_counts(pieces)
    assert equal.rdd.getNumPartitions() == counts.rdd.getNumPartitions() == 9
    assert "Join" not in equal._jdf.queryExecution().optimizedPlan().toString()
    rows = pieces.collect()
    first = {(r.pattern_id, r.fragment): min(q.frag_id for q in rows if q[0] == r[0] and q.fragment == r.fragment) for r in rows}
    assert sorted(map(tuple, equal.collect())) == sorted((r.pattern_id, r.frag_id, first[r.pattern_id, r.fragment]) for r in rows)
    assert sorted(map(tuple, counts.collect())) == sorted((i, 7, len({f for p, f in first if p == i})) for i in {r.pattern_id for r in rows})
