"""Centroid clustering (operator 12): Lloyd's rounds over integers, with Elkan's bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to every
centroid from round to round, in a table in the shared folder. When centroids move, the bounds move with
them; with the distances between centroids they show which of a vector's distances need not be looked at.
Bounds are rounded away from the truth and rule out only what is farther for certain, so ties stay and
exact integer distances decide: the result is that of Lloyd's rounds without bounds.

Rounds move no vectors between tasks. The driver sees the centroids alone: k times their components.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, discard, table

#: Components are multiplied by this before they are floored; the largest absolute value that may result,
#: up to which all distances fit a long.
SCALE, LARGEST = 64, 1 << 26
COUNT, ROUNDS, SIZE, SEED = 16, 3, 64, 1


def squared(a, b):
    """Exact squared distances of rows of integers."""
    import numpy as np

    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


def above(squares):
    """Distances of exact squares, rounded up to float32."""
    import numpy as np

    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(squares):
    """Distances of exact squares, rounded down to float32."""
    import numpy as np

    return np.maximum(0, np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf)))


class Round:
    """One assignment of vectors to centroids; `before` are the centroids of the round before it, if any."""

    def __init__(self, centroids, before=None):
        import numpy as np

        self.centroids, between = centroids, squared(centroids[:, None], centroids[None])
        # Half the distances between centroids, rounded down; half of a float is exact.
        self.half = below(between) / np.float32(2)
        others = self.half + np.where(np.eye(len(centroids)) > 0, np.float32(np.inf), np.float32(0))
        self.nearest = others.min(1)
        moved = None if before is None else squared(centroids, before)
        self.moved = None if moved is None else np.where(moved > 0, above(moved), np.float32(0))

    def first(self, rows):
        """(cluster, upper, lower, distances looked at) of rows without bounds."""
        import numpy as np

        all_ = np.stack([squared(rows, c) for c in self.centroids], axis=1)
        cluster = all_.argmin(1).astype(np.int32)
        return cluster, above(all_[np.arange(len(rows)), cluster]), below(all_), all_.size

    def next(self, rows, cluster, upper, lower):
        """The same, from the bounds of the round before."""
        import numpy as np

        cluster, looked = cluster.copy(), 0
        moved, inf = self.moved, np.float32(np.inf)
        upper = np.where(moved[cluster] > 0, np.nextafter(upper + moved[cluster], inf), upper)
        lower = np.where(moved > 0, np.maximum(0, np.nextafter(lower - moved, -inf)), lower)
        # What is certainly nearer to its centroid than half the way to any other stays.
        at = np.flatnonzero(upper >= self.nearest[cluster])

        def open_(at, own, most):
            out = (lower[at] <= most[:, None]) & (self.half[own] <= most[:, None])
            out[np.arange(len(at)), own] = False
            return out

        at = at[open_(at, cluster[at], upper[at]).any(1)]
        own = cluster[at]
        best = squared(rows[at], self.centroids[own])
        looked += len(at)
        most = above(best)
        lower[at, own] = below(best)
        left = open_(at, own, most)
        for c in range(len(self.centroids)):
            near = np.flatnonzero(left[:, c] & (lower[at, c] <= most) & (self.half[own, c] <= most) & (own != c))
            if not len(near):
                continue
            found = squared(rows[at[near]], self.centroids[c])
            looked += len(near)
            lower[at[near], c] = below(found)
            wins = (found < best[near]) | (found == best[near]) & (c < own[near])
            near, found = near[wins], found[wins]
            own[near], best[near], most[near] = c, found, above(found)
        cluster[at], upper[at] = own, most
        return cluster, upper, lower, looked


_STATE = "v binary, cluster int, upper float, lower binary"


def _integers(batch, size: int):
    import numpy as np
    import pyarrow.compute as pc

    values = np.floor(SCALE * pc.list_flatten(batch.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, size)
    if np.abs(values).max(initial=0) > LARGEST:
        raise ArithmeticError(f"a scaled component exceeds {LARGEST}, so distances might not fit")
    return values.astype(np.int64)


def _matrix(column, kind, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _packed(rows):
    return pa.array([bytes(x) for x in rows], pa.binary())


def _assigned(rows: DataFrame, turn: Round, size: int) -> DataFrame:
    """(id, v, cluster, upper, lower, distance) of rows (id, vector), or of rows of the round before."""
    import numpy as np

    kind, fresh = rows.schema["id"].dataType.simpleString(), "v" not in rows.columns

    def run(batches):
        for batch in batches:
            if fresh:
                v = _integers(batch, size)
                cluster, upper, lower, _ = turn.first(v)
            else:
                v = _matrix(batch["v"], np.int32, size).astype(np.int64)
                cluster, upper, lower, _ = turn.next(v, batch["cluster"].to_numpy(), batch["upper"].to_numpy(), _matrix(batch["lower"], np.float32, len(turn.centroids)))
            distance = squared(v, turn.centroids[cluster])
            columns = [batch["id"], _packed(v.astype(np.int32)), pa.array(cluster), pa.array(upper), _packed(lower.astype(np.float32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, f"id {kind}, {_STATE}, distance long")


def _means(state: DataFrame, centroids, size: int):
    """The centroids after the exact floors of their vectors' means; those without vectors stay."""
    import numpy as np

    count = len(centroids)

    def run(batches):
        sums, n = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            cluster, v = batch["cluster"].to_numpy(), _matrix(batch["v"], np.int32, size)
            for c in np.unique(cluster):
                own = v[cluster == c]
                sums[c] += own.sum(0, dtype=np.int64)
                n[c] += len(own)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([[int(n[c]), *sums[c].tolist()] for c in there], pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = centroids.copy()
    found: dict[int, dict[int, int]] = {}
    for c, at, x in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect():
        found.setdefault(c, {})[at] = int(x)
    for c, sums in found.items():
        out[c] = [sums[i + 1] // sums[0] for i in range(size)]
    return out


def cluster(vectors: DataFrame, count: int = COUNT, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of exactly
    `size` components, none of them null or non-finite; others take no part.

    Components x become floor(64 * x). Centroids start as the `count` vectors of the smallest sha256 of
    `seed:id`, null ids last, then by id and vector; with fewer vectors there are fewer. Each round takes
    every vector to the nearest centroid (ties: smaller number) and each centroid to the floor of the mean
    of its vectors; then vectors are assigned once more. Repeated rows and ids are rows of their own; other
    columns are ignored. Scaled components above 2^26 raise ArithmeticError. No vectors give no rows.
    """
    import numpy as np

    spark = vectors.sparkSession
    if count < 1 or rounds < 0:
        raise ValueError("count must be positive and rounds must not be negative")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kept = kept.where(f"size(vec) = {size} AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.orderBy(name.asc_nulls_last(), "id", "vec").limit(count).toArrow().combine_chunks()
    kind = kept.schema["id"].dataType.simpleString()
    if not starts.num_rows:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.concatenate([_integers(b, size) for b in starts.to_batches()])
    state, turn = kept, Round(centroids)
    for _ in range(rounds):
        new = cut(_assigned(state, turn, size).drop("distance"))
        if state is not kept:
            discard(state)
        before, centroids = centroids, _means(new, centroids, size)
        state, turn = new, Round(centroids, before)
    last = cut(_assigned(state, turn, size).select("id", "cluster", "distance"))
    if state is not kept:
        discard(state)
    inertia = {c: int(x) for c, x in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    facts = [(c, x, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in sorted(inertia.items())]
    # As many rows as there are centroids.
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c, v AS w FROM k QUALIFY c < {COUNT})"]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, v, c, w, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        steps.append(f"""s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({SIZE})) AS i FROM a{i}) GROUP BY c, i)""")
        steps.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{i} GROUP BY c)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN m{i} m USING (c))")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM {last}"""


ORACLE_SQL = _sql()
