"""k-mismatch search for pattern tables of any size: seeds of patterns and of texts meet in a join.

1. The patterns' seeds are a relation (hash, p, off), made by tasks; a filter of which hashes there are, of
   a fixed size, is all that reaches the driver.
2. Equal texts are searched once. Texts are cut into ranges. Each place whose hash passes the filter is a text seed.
3. Seeds join by hash. Each hash has SALTS places: a text seed goes to one of them, a pattern's seed to
   all, so a hash that very many texts hold is no one task's. At most BROADCAST_ROWS seeds are broadcast.
4. A hit is a diagonal of pattern against text. Different diagonals, once each, join the patterns and the
   ranges that they stand in, and the stretches are compared.
5. Each row joins what was found in its text. Texts of very many rows are dealt to SALTS places.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.operators import tables
from motifspark.operators.search import CELLS, Hasher, _slices, codes, ranges, seeds_of, spread
from motifspark.operators.tables import joinable, shuffled, written

#: log2 of the bits of the filter of seed hashes, and places of each hash in the join.
FILTER_BITS, SALTS = 25, 16
#: Starts of a range at least; longer patterns need longer ranges.
RANGE = 4096
#: A text with at least 1/HOT of all rows is dealt out; there are at most HOT of them.
HOT = 1000
#: Bytes of the ranges that a task hashes at once.
SLICE_BYTES = 1 << 20


def _pattern_seeds(patterns: DataFrame, circular: bool) -> DataFrame:
    """(size, hash, p, off) of every seed of patterns (p, pattern, k)."""
    import numpy as np

    def run(batches):
        for batch in batches:
            texts = batch["pattern"].to_pylist()
            m, k = np.array([len(t) for t in texts], np.int64), batch["k"].to_numpy().astype(np.int64)
            own = [codes(t + t[:-1] if circular else t) for t in texts]
            flat = np.concatenate([np.empty(0, np.uint32), *own])
            lengths = np.array([len(x) for x in own], np.int64)
            bases = np.cumsum(lengths) - lengths
            step, size, count = seeds_of(m, k, circular)
            for s in np.unique(size[step > 0]).tolist():
                which = np.flatnonzero(size == s)
                numbers = np.repeat(which, count[which])
                offs = (np.arange(len(numbers)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])) * step[numbers]
                keys = Hasher.at(flat, bases[numbers] + offs, s)
                columns = [pa.array(np.full(len(keys), s, np.int32)), pa.array(keys.view(np.int64)), batch["p"].take(pa.array(numbers)), pa.array(offs.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["size", "hash", "p", "off"])

    return patterns.select("p", "pattern", "k").mapInArrow(run, "size int, hash long, p long, off int")


def _filter(seeds: DataFrame):
    """Which first FILTER_BITS bits of hashes there are, as bytes of bits: at most 2^FILTER_BITS / 64 rows."""
    import numpy as np

    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("h")
    found = seeds.select(place).groupBy(F.expr("h DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _text_seeds(pieces: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(size, hash, t, pos) of the places of ranges (t, base, owned, text) whose hash passes the filter."""
    import numpy as np

    shared = pieces.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in _slices(batches, SLICE_BYTES):
            # Ranges stand one after the other; a window is inside of one and begins at what it owns.
            texts = batch["text"].to_pylist()
            lengths = np.array([len(x) for x in texts], np.int64)
            ends = np.cumsum(lengths)
            t, base, owned = (batch[c].to_numpy() for c in ("t", "base", "owned"))
            sums = Hasher.sums(codes("".join(texts)))
            for size in sizes:
                if len(sums) <= size:
                    continue
                hashes = Hasher.windows(sums, size)
                place = hashes >> np.uint64(64 - FILTER_BITS)
                at = np.flatnonzero(shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                own = np.searchsorted(ends, at, "right")
                pos = at - (ends - lengths)[own]
                inside = (pos < owned[own]) & (at + size <= ends[own])
                at, own, pos = at[inside], own[inside], pos[inside]
                columns = [pa.array(np.full(len(at), size, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(t[own]), pa.array(pos + base[own])]
                yield pa.RecordBatch.from_arrays(columns, ["size", "hash", "t", "pos"])

    return pieces.select("t", "base", "owned", "text").mapInArrow(run, "size int, hash long, t long, pos long")


def _compare(rows: DataFrame, circular: bool) -> DataFrame:
    """(t, text_id, p, pattern_id, pos, distance, rotation, size) of rows with a diagonal a, and the text's
    stretch there, of which the first `lead` characters would stand before the text."""
    import numpy as np

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            patterns, windows = batch["pattern"].to_pylist(), batch["stretch"].to_pylist()
            a, lead, k = (batch[c].to_numpy().astype(np.int64) for c in ("a", "lead", "k"))
            m = np.array([len(x) for x in patterns])
            found = [np.empty((4, 0), np.int64)]
            for size in np.unique(m).tolist():
                length = 2 * size - 1 if circular else size
                same = np.flatnonzero(m == size)
                for i in range(0, len(same), step := max(1, CELLS // length)):
                    part = same[i : i + step]
                    # Code points are below 2^21, so what is no text equals nothing.
                    text = np.full((len(part), length), 1 << 21, np.uint32)
                    own = np.empty((len(part), length), np.uint32)
                    there = [windows[j] for j in part]
                    counts = np.array([len(x) for x in there], np.int64)
                    column = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - lead[part], counts)
                    text[np.repeat(np.arange(len(part)), counts), column] = codes("".join(there))
                    own[:] = codes("".join(patterns[j] + patterns[j][:-1] if circular else patterns[j] for j in part)).reshape(own.shape)
                    sums = np.zeros((len(part), length + 1), np.int32)
                    np.cumsum(text != own, axis=1, out=sums[:, 1:])
                    distance = sums[:, size:] - sums[:, :-size]
                    # A window is inside if none of it is missing.
                    gone = np.zeros((len(part), length + 1), np.int32)
                    np.cumsum(text == 1 << 21, axis=1, out=gone[:, 1:])
                    row, rotation = np.nonzero((distance <= k[part][:, None]) & (gone[:, size:] == gone[:, :-size]))
                    found.append(np.stack([part[row], a[part[row]] + rotation, distance[row, rotation], rotation]))
            which, start, distance, rotation = np.concatenate(found, axis=1)
            take = pa.array(which)
            columns = [*(batch[c].take(take) for c in ("t", "text_id", "p", "pattern_id")), pa.array(start), pa.array(distance.astype(np.int32)), pa.array(rotation.astype(np.int32)), pa.array(m[which].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["t", "text_id", "p", "pattern_id", "pos", "distance", "rotation", "size"])

    return rows.mapInArrow(run, f"t long, text_id {kinds['text_id']}, p long, pattern_id {kinds['pattern_id']}, pos long, distance int, rotation int, size int")


def _key():
    return F.unhex(F.sha2("text", 256))


def _members(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of texts as (text_id, text_key, place), and the keys of texts that very many rows have: for
    these, place is one of SALTS, else 0."""
    rows = written(texts.select("text_id", _key().alias("text_key"), F.monotonically_increasing_id().alias("row")))
    bound = max(1, -(-rows.count() // HOT))
    hot = rows.groupBy("text_key").count().where(f"count >= {max(2, bound)}").select("text_key", F.lit(True).alias("hot"))
    hot = F.broadcast(written(hot))
    place = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0)
    return rows.join(hot, "text_key", "left").select("text_id", "text_key", place.alias("place")), hot


def _for_all(found: DataFrame, members: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of found, whose text_id is a text's key, for each of members."""
    found = found.withColumnRenamed("text_id", "text_key").join(hot, "text_key", "left")
    places = F.when(F.col("hot"), F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    found = found.withColumn("place", F.explode(places)).drop("hot")
    return found.join(shuffled(members), ["text_key", "place"]).drop("text_key", "place")


def seed_join(texts: DataFrame, patterns: DataFrame, circular: bool, longest: int) -> DataFrame:
    """(text_id, pattern_id, pos, distance, rotation, size) of texts (text_id, text) and patterns
    (pattern_id, pattern, k) of more than k and at most `longest` characters. Patterns and
    different texts are written with a number for each, and the texts' rows with theirs, so that repeated and
    null ids are rows of their own and lost executors change none."""
    span = max(RANGE, longest)
    patterns = written(patterns.withColumn("p", F.monotonically_increasing_id()))
    members, hot = _members(texts)
    unique = texts.select("text").distinct().select(_key().alias("text_id"), "text", F.monotonically_increasing_id().alias("t"))
    cut = ranges(unique, span, 2 * longest - 1 if circular else longest - 1, ["t", "text_id"])
    pieces = written(cut)
    seeds = _pattern_seeds(patterns, circular)
    counts = dict(map(tuple, seeds.groupBy("size").count().collect()))
    hits = _text_seeds(spread(pieces), sorted(counts), _filter(seeds))
    if sum(counts.values()) <= tables.BROADCAST_ROWS:
        met = hits.join(F.broadcast(seeds), ["size", "hash"])
    else:
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("t", "pos"), F.lit(SALTS)))
        seeds = seeds.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        met = hits.join(shuffled(seeds), ["size", "hash", "salt"])
    met = met.select("t", "p", (F.col("pos") - F.col("off")).alias("a"))
    met = (met if circular else met.where("a >= 0")).distinct()
    met = met.join(joinable(patterns), "p").withColumn("base", F.expr(f"greatest(a, 0L) div {span} * {span}"))
    length = "2 * length(pattern) - 1" if circular else "length(pattern)"
    rows = met.join(shuffled(pieces.drop("owned")), ["t", "base"]).withColumn("lead", F.expr("CAST(greatest(0L, -a) AS INT)"))
    rows = rows.withColumn("stretch", F.expr(f"substring(text, CAST(greatest(a, 0L) - base AS INT) + 1, {length} - lead)")).drop("text", "base")
    found = _compare(rows, circular)
    if circular:
        best = F.min(F.struct("distance", "rotation")).alias("best")
        found = found.groupBy("t", "p", "pos").agg(best, *(F.first(c).alias(c) for c in ("text_id", "pattern_id", "size")))
        found = found.select("text_id", "pattern_id", "pos", "best.distance", "best.rotation", "size")
    return _for_all(found, members, hot).select("text_id", "pattern_id", "pos", "distance", "rotation", "size")
