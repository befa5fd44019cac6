import random

import duckdb
import numpy as np
import pytest

from motifspark.llm import hard_negatives
from motifspark.llm.hard_negatives import ORACLE_SQL, Quantiser, mine, op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, keep=5):
    """(anchor, positive, rank, negative, scores) by comparing every anchor with every row."""
    known = []
    for i, (vec_id, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        known.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = []
    for i, vec_id, label, v in known:
        if vec_id is None or vec_id % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), o is None, o or 0, j, o, m) for j, o, m, w in known if j != i))
        for p in [s for s in scored if s[5] == label][:keep]:
            inside = [s for s in scored if s[5] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(vec_id, p[4], rank + 1, s[4], -p[0], -s[0]) for rank, s in enumerate(inside[:keep])]
    return sorted(out, key=str)


def rows_of(n, size, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, size))
    return [(i, (centres[draw.integers(6)] + 0.4 * draw.normal(size=size)).astype(np.float32).tolist(), int(draw.integers(4))) for i in range(n)]


def found(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, op11_hard_negatives(spark, path).collect()), key=str)


@pytest.mark.parametrize("tile, block, together", [(4096, 8192, 256), (64, 3, 2)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, tile, block, together):
    for name, value in (("TILE", tile), ("BLOCK", block), ("TOGETHER", together), ("WORDS", 16), ("SAMPLE", 200)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(1500, 10, 3)
    assert found(spark, rows, tmp_path) == brute(rows) != []


def test_ties_repeats_nulls_and_odd_vectors(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([0, 100, 200, 3, 7, None, *range(300)]), [rng.choice([0.0, 0.25, -0.5]) for _ in range(3)], rng.choice([1, 2, None])) for _ in range(400)]
    rows += [(100, [1.0, 1.0, 1.0], 1)] * 3 + [(5, [1.0, 1.0, 1.0], 2)] * 4 + [(300, None, 1), (400, [1.0, None, 1.0], 1), (500, [1.0, float("nan"), 1.0], 1), (600, [float("inf")] * 3, 1)]
    want = brute(rows)
    # Rows of one id and vector are alike, so only their labels tell apart which of them came first.
    assert sorted(x[:1] + x[2:] for x in found(spark, rows, tmp_path)) == sorted(x[:1] + x[2:] for x in want) or found(spark, rows, tmp_path) == want


def test_no_rows_no_anchors_and_other_columns(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)], tmp_path) == []
    rows = spark.createDataFrame([(0, [1.0, 0.5], 1, "x", 4), (1, [1.0], 1, "y", 5), (2, [0.95], 2, "z", 6)], SCHEMA + ", row string, id int")
    assert [tuple(r) for r in mine(rows, "id % 100 = 0").collect()] == [(0, 1, 1, 2, 256 * 256, 256 * 243)]
    with pytest.raises(Exception, match="exceeds"):
        mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), "id % 100 = 0").collect()


def test_bounds_hold_and_prune(monkeypatch):
    draw = np.random.default_rng(1)
    rows = np.floor(256 * draw.normal(size=(3000, 64)) / 8).astype(np.int32)
    quantiser = Quantiser(rows[:2000], 64)
    codes, rest = quantiser.encode(rows)
    about, norms, slack = quantiser.scores(rows[:50], codes)
    exact = rows[:50].astype(np.int64) @ rows.T.astype(np.int64)
    most = norms[:, None] * rest + slack[:, None]
    assert (np.abs(exact - about) <= most).all()
    # A bound that ruled nothing out would be of no use.
    best = np.sort(exact, axis=1)[:, -6]
    assert ((about + most) >= best[:, None]).mean() < 0.02


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    wanted = con.execute(ORACLE_SQL)
    columns = [c[0] for c in wanted.description]
    out = op11_hard_negatives(spark, sf)
    assert out.columns == columns
    assert sorted(map(tuple, out.collect())) == sorted(wanted.fetchall()) != []
