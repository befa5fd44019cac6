"""Hard-negative mining (operator 11): product quantisation with stored residual norms.

Vectors become integers. A codebook of each subspace is fitted on a bounded sample; every row is
indexed by its codes and by the norm of its residual, the part that the codes leave out. For an anchor,
a table of its inner products with all codewords gives each row's score up to norm(anchor) * norm(residual):
what this bound, widened by the rounding of the sums, rules out is never looked at, and the integer inner
product of all else decides. So the bound only saves work, and the results are exact.

Anchors are met in blocks: rows stand in tiles of at most TILE rows, anchors in blocks of at most about
BLOCK, and an equi-join brings each tile to each block. A task keeps the best few rows of each anchor that
it has met so far, which raise the bound for its further tiles. Neither side passes through the driver.
"""

from __future__ import annotations

from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifspark.llm.common import cut, discard, table

#: Components are multiplied by this before they are floored; the largest absolute value that may result.
SCALE, LARGEST = 256, 1 << 22
#: Rows on which codebooks are fitted at most; codewords of a subspace, its components, rounds of fitting.
SAMPLE, WORDS, WIDTH, FITS = 8192, 256, 2, 6
#: Rows of a tile, anchors of a block, and anchors whose tables of inner products stand in memory together.
TILE, BLOCK, TOGETHER = 4096, 8192, 256
#: Pairs whose components are multiplied at once, and blocks of which a task keeps the best rows.
PAIRS, HELD = 1 << 15, 4


class Quantiser:
    """Codebooks of subspaces of WIDTH components; vectors are padded by zeros."""

    def __init__(self, sample, size: int):
        import numpy as np

        self.parts = max(1, -(-size // WIDTH))
        rows, draw = self.padded(sample), np.random.default_rng(11)
        self.books = []
        for m in range(self.parts):
            own = rows[:, m * WIDTH : (m + 1) * WIDTH]
            different = np.unique(own, axis=0)
            book = different[draw.permutation(len(different))[:WORDS]]
            for _ in range(FITS if len(different) > WORDS else 0):
                code = self._nearest(own, book)
                count = np.bincount(code, minlength=len(book))
                sums = np.stack([np.bincount(code, own[:, c], len(book)) for c in range(WIDTH)], axis=1)
                book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book).astype(np.float32)
            self.books.append(book)
        self.longest = float(np.sqrt(sum((b.astype(np.float64) ** 2).sum(1).max() for b in self.books)))

    def padded(self, values):
        import numpy as np

        out = np.zeros((len(values), self.parts * WIDTH), np.float32)
        out[:, : values.shape[1]] = values
        return out

    @staticmethod
    def _nearest(own, book):
        return ((book * book).sum(1)[None, :] - 2 * (own @ book.T)).argmin(1)

    def encode(self, values):
        """Codes (rows, parts), and norms of the residuals, rounded up."""
        import numpy as np

        rows = self.padded(values)
        codes = np.empty((len(rows), self.parts), np.uint8)
        left = np.zeros(len(rows))
        for m, book in enumerate(self.books):
            own = rows[:, m * WIDTH : (m + 1) * WIDTH]
            codes[:, m] = self._nearest(own, book)
            left += ((own.astype(np.float64) - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.nextafter(np.sqrt(left).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))

    def scores(self, anchors, codes):
        """Inner products of anchors with what the codes stand for, by tables, and of each anchor the
        most by which rounding may have moved one."""
        import numpy as np

        rows = self.padded(anchors)
        out = np.zeros((len(rows), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            out += np.take(rows[:, m * WIDTH : (m + 1) * WIDTH] @ book.T, codes[:, m], axis=1)
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        return out, norms, (self.parts + WIDTH + 4) * 2.0**-22 * norms * self.longest


class Best:
    """The first `keep` rows of each group by score, then id (null last), then row."""

    def __init__(self, keep: int, groups: int):
        import numpy as np

        self.keep, self.least = keep, np.full(groups, -np.inf)
        self.rows = [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]

    def add(self, group, score, ids, row, null) -> None:
        import numpy as np

        new = [np.concatenate(x) for x in zip(self.rows, (group, score, ids, row, null))]
        group, score, ids, row, null = new
        order = np.lexsort((row, ids, null, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        turn = np.arange(len(group)) - first
        kept = order[turn < self.keep]
        self.rows = [x[kept] for x in new]
        full = turn == self.keep - 1
        self.least[group[full]] = score[order][full]


def _integers(batch, vec: int):
    """(rows, values): the places of the rows that take part, and their scaled components, padded by zeros."""
    import numpy as np
    import pyarrow.compute as pc

    lists = batch.column(vec)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wrong = ~np.isfinite(numbers)
    taken = pc.is_valid(lists).to_numpy(zero_copy_only=False).copy()
    taken[owner[wrong]] = False
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = taken[owner]
    values = np.zeros((len(sizes), sizes[taken].max(initial=0)))
    values[owner[inside], place[inside]] = np.floor(SCALE * numbers[inside])
    if np.abs(values).max(initial=0) > LARGEST:
        raise ArithmeticError(f"a scaled component exceeds {LARGEST}, so scores might not be exact")
    return np.flatnonzero(taken), values[taken].astype(np.int32)


def _matrix(column, kind, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


_INDEX = "row long, id long, label long, v binary, codes binary, rest float"


def index(vectors: DataFrame, quantiser: Quantiser, size: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, v, codes, rest) of every row that takes part: its components as int32, its codes
    and the norm of its residual, written to a table; `row` tells rows apart."""
    import numpy as np

    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        for batch in batches:
            taken, values = _integers(batch, 3)
            if len(taken):
                codes, rest = shared.value.encode(values)
                wide = np.zeros((len(values), size), np.int32)
                wide[:, : values.shape[1]] = values
                own = batch.take(pa.array(taken))
                binary = [pa.array([bytes(x) for x in rows], pa.binary()) for rows in (wide, codes)]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *binary, pa.array(rest)], [*own.schema.names[:3], "v", "codes", "rest"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    return cut(rows.where("label IS NOT NULL").mapInArrow(run, _INDEX))


_PACKED = "n int, row binary, id binary, none binary, label binary, v binary, codes binary, rest binary"


def _tiles(rows: DataFrame) -> DataFrame:
    """The index, TILE rows in one."""
    import numpy as np
    import pyarrow.compute as pc

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, TILE):
                b = whole.slice(low, TILE)
                none = pc.is_null(b["id"]).to_numpy(zero_copy_only=False)
                flat = [b["row"].to_numpy().tobytes(), pc.fill_null(b["id"], 0).to_numpy().tobytes(), none.tobytes(), b["label"].to_numpy().tobytes()]
                flat += [b"".join(b[c].to_pylist()) for c in ("v", "codes")] + [b["rest"].to_numpy().astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in flat)], _PACKED.replace(" binary", "").replace(" int", "").split(", "))

    return rows.mapInArrow(run, _PACKED)


def _blocks(anchors: DataFrame, count: int) -> DataFrame:
    """anchors (row, label, v, wanted), the scores that bound each one's windows, as many blocks as count, packed."""
    block = F.pmod(F.xxhash64("row"), F.lit(count)).alias("block")
    return anchors.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("row", "label", "v", "wanted"))).alias("anchors"))


def _met(tiles: DataFrame, blocks: DataFrame, count: int, quantiser: Quantiser, size: int, keep: int, share: tuple[int, int] | None, places: int) -> DataFrame:
    """(anchor, high, score, id, other) of the rows that each task finds best: without share the rows of
    the anchor's own label, else those of other labels whose score is within the share of one wanted, which is high."""
    import numpy as np

    spark = tiles.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)
    # Each tile meets a block in one of the places, so that few blocks fill many tasks. Copies of the blocks
    # take far more than Spark expects, which would broadcast them.
    left = tiles.withColumn("place", F.pmod(F.monotonically_increasing_id(), F.lit(places))).withColumn("block", F.explode(F.expr(f"sequence(0L, {count - 1}L)")))
    right = blocks.withColumn("place", F.explode(F.expr(f"sequence(0L, {places - 1}L)")))

    def out(block, best):
        group, score, ids, row, null = best.rows
        at, which = np.divmod(group, block["windows"])
        high = block["high"][at, which] if share else np.zeros(len(at), np.int64)
        columns = [pa.array(block["row"][at]), pa.array(high), pa.array(score), pa.array(ids, mask=null), pa.array(row)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "high", "score", "id", "other"])

    def opened(anchors):
        rows = anchors.values if hasattr(anchors, "values") else anchors
        wanted = [list(dict.fromkeys(w)) for w in rows.field("wanted").to_pylist()]
        width = max(1, *map(len, wanted)) if share else 1
        block = {"row": rows.field("row").to_numpy(), "label": rows.field("label").to_numpy(), "v": _matrix(rows.field("v"), np.int32, size), "windows": width}
        if share:
            # An anchor of fewer windows has ones that nothing is in.
            block["high"] = np.array([w + [0] * (width - len(w)) for w in wanted], np.int64)
            real = np.array([[1] * len(w) + [0] * (width - len(w)) for w in wanted], bool)
            block["low"] = np.where(real, -(-(share[0] * block["high"]) // share[1]), 1)
            block["high"] = np.where(real, block["high"], 0)
        return block

    def meet(block, best, t):
        quantiser, windows = shared.value, block["windows"]
        for low in range(0, len(block["row"]), TOGETHER):
            v, label, row = (block[c][low : low + TOGETHER] for c in ("v", "label", "row"))
            about, norms, slack = quantiser.scores(v, t["codes"])
            most = norms[:, None].astype(np.float32) * np.float32(1 + 1e-6) * t["rest"][None, :] + slack[:, None].astype(np.float32) * np.float32(1 + 1e-6)
            least = best.least.reshape(-1, windows)[low : low + TOGETHER]
            upper = about + most
            if share:
                lows, highs = block["low"][low : low + TOGETHER], block["high"][low : low + TOGETHER]
                floor = np.where(lows > highs, np.inf, np.maximum(least, lows)).min(1)
                near = (label[:, None] != t["label"]) & (upper >= floor[:, None]) & (about - most <= highs.max(1)[:, None])
            else:
                own = (label[:, None] == t["label"]) & (row[:, None] != t["row"])
                floor = least[:, 0]
                if upper.shape[1] > keep:
                    sure = np.where(own, about - most, -np.inf)
                    floor = np.maximum(floor, np.partition(sure, -keep, axis=1)[:, -keep])
                near = own & (upper >= floor[:, None])
            a, r = np.nonzero(near)
            score = np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", v[a[i : i + PAIRS]], t["v"][r[i : i + PAIRS]], dtype=np.int64) for i in range(0, len(a), PAIRS))])
            for w in range(windows):
                inside = (score >= np.maximum(lows[a, w], least[a, w])) & (score <= highs[a, w]) if share else score >= least[a, 0]
                x, y = a[inside], r[inside]
                best.add((x + low) * windows + w, score[inside], t["id"][y], t["row"][y], t["none"][y])

    def run(batches):
        held = {}
        for batch in batches:
            for i in range(batch.num_rows):
                name, n = batch["block"][i].as_py(), batch["n"][i].as_py()
                if name not in held:
                    if len(held) >= HELD:
                        yield out(*held.pop(next(iter(held))))
                    block = opened(batch["anchors"][i])
                    held[name] = block, Best(keep, len(block["row"]) * block["windows"])
                raw = {c: batch[c][i].as_py() for c in ("row", "id", "none", "label", "v", "codes", "rest")}
                tile = {c: np.frombuffer(raw[c], kind) for c, kind in (("row", np.int64), ("id", np.int64), ("none", bool), ("label", np.int64), ("rest", np.float32))}
                tile |= {"v": np.frombuffer(raw["v"], np.int32).reshape(n, size), "codes": np.frombuffer(raw["codes"], np.uint8).reshape(n, -1)}
                meet(*held[name], tile)
        for x in held.values():
            yield out(*x)

    found = left.join(right.hint("merge"), ["block", "place"]).drop("place").mapInArrow(run, "anchor long, high long, score long, id long, other long")
    first = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, low_percent: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each
    of its first `positives` other rows of its label, the first `negatives` rows of other labels whose
    score is at least low_percent and at most 100 percent of the positive's.

    `anchors` is SQL of the rows that are anchors, over id and label. A score is the inner product of the
    vectors, whose components x become floor(256 * x); higher ones come first, ties by smaller id, null
    ids last. Rows of a null label or vector or of a null or non-finite component take no part; shorter
    vectors count as padded by zeros. Repeated rows are rows of their own, and so anchors of their own.
    Scaled components above 2^22 raise ArithmeticError. No rows, or no anchors, give none. Other columns
    are ignored. The rows are exact whatever codebooks the sample gives.
    """
    spark = vectors.sparkSession
    sizes = vectors.select(F.size(vec_col).alias("size")).agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    n, size = sizes["n"], max(1, sizes["size"] or 1)
    drawn = vectors.where(F.col(label_col).isNotNull()).select(F.col(vec_col).alias("vec"))
    if n > SAMPLE:
        # A hash of the vector draws it, so a third of all rows that are equal is drawn together or not at all.
        drawn = drawn.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < max(1, (SAMPLE << 20) // n))
    sample = [b for b in drawn.limit(SAMPLE).toArrow().combine_chunks().to_batches()]
    values = [_integers(b, 0)[1] for b in sample]
    import numpy as np

    fitted = np.zeros((max(1, sum(map(len, values))), size), np.int32)
    at = 0
    for x in values:
        fitted[at : at + len(x), : x.shape[1]] = x
        at += len(x)
    quantiser = Quantiser(fitted, size)
    rows = index(vectors, quantiser, size, id_col, vec_col, label_col)
    chosen = rows.where(anchors)
    count = -(-chosen.count() // BLOCK)
    if not count:
        discard(rows)
        return spark.createDataFrame([], _OUT)
    # No more places than there are tiles, or cores twice over.
    places = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2 * spark.sparkContext.defaultParallelism, -(-n // TILE)))
    tiles, none = _tiles(rows), F.expr("CAST(array() AS array<long>)")
    near = _met(tiles, _blocks(chosen.withColumn("wanted", none), count), count, quantiser, size, positives, None, places)
    near = cut(near.select("anchor", F.col("score").alias("high"), "id", "other"))
    wanted = near.groupBy("anchor").agg(F.collect_set("high").alias("wanted")).withColumnRenamed("anchor", "row")
    common = gcd(low_percent, 100)
    far = _met(tiles, _blocks(chosen.join(wanted.hint("merge"), "row"), count), count, quantiser, size, negatives, (low_percent // common, 100 // common), places)
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    positive = near.select("anchor", "high", F.col("id").alias("positive_id")).join(names.hint("merge"), "anchor")
    out = far.select("anchor", "high", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id")).join(positive.hint("merge"), ["anchor", "high"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("high").alias("positive_score"), "negative_score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), "id % 100 = 0")


ORACLE_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, x.r AS r, x.id AS id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score FROM k a JOIN k x ON a.r <> x.r WHERE a.id % 100 = 0),
p AS (SELECT a, r, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, r) <= 5),
n AS (SELECT s.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
