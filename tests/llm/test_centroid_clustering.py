import hashlib

import duckdb
import numpy as np
import pytest

from motifspark.llm.centroid_clustering import ORACLE_SQL, Round, above, below, cluster, op12_centroid_clustering, squared

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, count, rounds, size):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:count]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        found = [min((distance(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn == rounds:
            break
        for n in range(len(centres)):
            own = [v for (_, v), f in zip(kept, found) if f[1] == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in found)
    each = [sum(d for d, m in found if m == n) for n in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, each[n], total, sha[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


@pytest.mark.parametrize("seed, step, rounds", [(1, 0.25, 3), (2, 0.02, 6), (3, 0.5, 0)])
def test_equals_brute_force_with_ties_nulls_and_repeats(spark, seed, step, rounds):
    draw = np.random.default_rng(seed)
    rows = [(i, (np.round(draw.normal(size=4) / step) * step).tolist()) for i in range(300)]
    rows += rows[:40] + [(None, [1.0, 0.0, 0.0, 0.0]), (1, None), (2, []), (3, [1.0]), (4, [1.0] * 5), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cluster string, distance int").repartition(3)
    out = cluster(docs, count=9, rounds=rounds, size=4)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 9, rounds, 4)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert sorted(map(tuple, cluster(spark.createDataFrame(rows, SCHEMA), size=2).collect()), key=str) == brute(rows, 16, 3, 2)
    none = cluster(spark.createDataFrame([(1, [0.5])], SCHEMA), size=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="exceeds"):
        cluster(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), size=2).collect()


def test_bounds_save_distances_and_keep_ties():
    draw = np.random.default_rng(5)
    rows = (draw.integers(0, 12, size=(2000, 1)) * 40 + draw.integers(-3, 4, size=(2000, 6))).astype(np.int64)
    centres = rows[:12].copy()
    cluster_, upper, lower, looked = Round(centres).first(rows)
    assert looked == 12 * len(rows)
    saved = []
    for _ in range(5):
        new = np.array([rows[cluster_ == c].sum(0) // max(1, (cluster_ == c).sum()) if (cluster_ == c).any() else centres[c] for c in range(12)])
        turn, centres = Round(new, centres), new
        cluster_, upper, lower, looked = turn.next(rows, cluster_, upper, lower)
        every = np.stack([squared(rows, c) for c in centres], axis=1)
        assert (cluster_ == every.argmin(1)).all()
        assert (upper.astype(np.float64) ** 2 >= every.min(1) * (1 - 1e-12)).all() and (lower.astype(np.float64) ** 2 <= every * (1 + 1e-12)).all()
        saved.append(1 - looked / every.size)
    assert max(saved) > 0.5


def test_bounds_are_rounded_away_from_the_truth():
    squares = np.concatenate([np.arange(5000), np.array([2**50 + 1, 2**60, 2**61 + 12345])]).astype(np.int64)
    for s, up, down in zip(squares.tolist(), above(squares).tolist(), below(squares).tolist()):
        assert int(down) ** 2 <= s and down <= up
        from fractions import Fraction

        assert Fraction(down) ** 2 <= s <= Fraction(up) ** 2


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    wanted = con.execute(ORACLE_SQL)
    columns = [c[0] for c in wanted.description]
    out = op12_centroid_clustering(spark, sf)
    assert out.columns == columns
    assert sorted(map(tuple, out.collect())) == sorted(wanted.fetchall()) != []
