"""Linear and circular k-mismatch search, by seeds, by scanning or by a join; exact multi-pattern scan.

A pattern within k mismatches keeps one of k+1 disjoint pieces whole; a rotation keeps one of the
pieces of the doubled pattern that start at each multiple of (m+1) div (k+2). A seed is the first
2^j characters of such a piece, so patterns of all lengths, and of different k, share a few seed lengths.

Patterns of at most PATTERN_CHARS characters are broadcast as sorted seed hashes, and the search is one
pass over the texts, which stay where they are read: a narrow map without any shuffle. In a task, texts stand
one after the other in an array of code points; a block of starts at a time is hashed at once, and halved
as long as it has more hits than a task should hold. Hits give diagonals of pattern against text; for long
patterns jumps by prefix hashes tell which diagonals are worth comparing; each different one is compared once.

Texts longer than a range of starts are cut into ranges that overlap by what a pattern may reach over,
and only these are spread over the cluster. A start belongs to one block of one range, so the rows are
distinct as they are made. Larger pattern tables are joined, see seed_join.py.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifspark.operators.symbols import encoded

#: Characters of the patterns that are broadcast; a larger table is joined by its seeds.
PATTERN_CHARS = 8_000_000
#: Starts that a task looks at together, hits that it holds at once, and cells of a comparison.
BLOCK, HITS, CELLS = 1 << 18, 1 << 20, 1 << 21
#: Starts of a range; a longer text goes to several tasks.
RANGE = 1 << 21
#: Starts of each text that a search which stops early looks at first; each further step takes four times as many.
FIRST_STEP = 256
#: Patterns from this length on are compared only where jumps let them pass.
LONG = 256
#: Bytes of the texts that a task joins; a longer text stands alone.
SLICE_BYTES = 1 << 22
#: Base of the rolling hash, odd and so invertible.
_BASE = 0x9DDFEA08EB382D69


def codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hasher:
    """Hashes of windows in an array of code points: equal windows, equal hashes. Its powers are kept from
    call to call and grow with the arrays."""

    up = down = None

    @classmethod
    def powers(cls, size: int):
        import numpy as np

        if cls.up is None or len(cls.up) < size:
            size = 1 << max(12, (size - 1).bit_length())
            power = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
            cls.up, cls.down = power(_BASE), power(pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down

    @classmethod
    def sums(cls, points):
        import numpy as np

        out = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * cls.powers(len(points) + 1)[0][: len(points)], out=out[1:])
        return out

    @staticmethod
    def mixed(found):
        import numpy as np

        found ^= found >> np.uint64(31)
        return found * np.uint64(_BASE)

    @classmethod
    def windows(cls, sums, size: int):
        return cls.mixed((sums[size:] - sums[:-size]) * cls.powers(len(sums))[1][: len(sums) - size])

    @classmethod
    def at(cls, points, starts, size: int):
        """Hashes of the windows of a size at some places only."""
        import numpy as np

        out, up = np.empty(len(starts), np.uint64), cls.powers(size + 1)[0][:size]
        for i in range(0, len(starts), rows := max(1, CELLS // size)):
            out[i : i + rows] = ((points[starts[i : i + rows, None] + np.arange(size)].astype(np.uint64) + np.uint64(1)) * up).sum(1, dtype=np.uint64)
        return cls.mixed(out)


def seeds_of(m, k, circular: bool):
    """(step, size, count) of the pieces of patterns of lengths m and thresholds k: seeds start at the
    first `count` multiples of step, and have `size` characters; a step of 0 means that there are none."""
    import numpy as np

    step = np.where(m > k, (m + 1) // (k + 2) if circular else m // (k + 1), 0)
    size = np.where(step > 0, 1 << np.maximum(0, np.frexp(np.maximum(step, 1))[1] - 1), 0)
    last = 2 * m - 1 - step if circular else k * step
    return step, size, np.where(step > 0, last // np.maximum(step, 1) + 1, 0)


class Patterns:
    """Patterns with their seeds, made once and broadcast. k is one threshold, or one a pattern."""

    def __init__(self, texts: list[str], k, circular: bool = False, scan: bool = False):
        import numpy as np

        self.circular, self.sizes = circular, np.array([len(t) for t in texts], np.int64)
        self.ks = np.broadcast_to(np.asarray(k, np.int64), len(texts)).copy()
        self.longest, self.shortest = int(self.sizes.max(initial=1)), int(self.sizes.min(initial=1))
        own = [codes(t + t[:-1] if circular else t) for t in texts]
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.bases = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([np.empty(0, np.uint32), *own])
        step, size, count = seeds_of(self.sizes, self.ks, circular)
        self.scanned = np.flatnonzero((step == 0) | scan)
        self.seeds, self._long = {}, None
        for s in np.unique(size[(step > 0) & (not scan)]).tolist():
            which = np.flatnonzero(size == s)
            numbers = np.repeat(which, count[which])
            offs = (np.arange(len(numbers)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])) * step[numbers]
            keys = Hasher.at(self.flat, self.bases[numbers] + offs, s)
            order = np.argsort(keys, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[keys >> np.uint64(48)] = True
            self.seeds[s] = known, keys[order], numbers[order], offs[order]

    @property
    def long_sums(self):
        """Prefix hashes of the long patterns, made in the worker that first needs them."""
        import numpy as np

        if self._long is None:
            self._long = np.zeros(len(self.flat) + len(self.sizes), np.uint64)
            for n in np.flatnonzero(self.sizes >= LONG):
                low = self.bases[n] + n
                self._long[low : low + self.lengths[n] + 1] = Hasher.sums(self.flat[self.bases[n] : self.bases[n] + self.lengths[n]])
        return self._long

    def __getstate__(self):
        return self.__dict__ | {"_long": None}

    def search(self, points, ends, block: int):
        """(pattern, start, distance, rotation) arrays of every match, starts counted over all texts; `ends`
        are the places where the texts that points holds end."""
        for low in range(0, len(points), block):
            yield from self._block(points, ends, low, min(low + block, len(points)))

    def first(self, points, ends, block: int, stop: int, by_end: bool):
        """The same for the first `stop` places of each text at which matches start (or, by_end, end), and
        how many starts were looked at: a text is read no further than these places need."""
        import numpy as np

        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at, open_, step, looked = begins.copy(), np.flatnonzero(ends > begins), min(FIRST_STEP, block), 0
        found = [np.empty((5, 0), np.int64)]
        while len(open_):
            for i in range(0, len(open_), group := max(1, block // step)):
                texts = open_[i : i + group]
                highs = np.minimum(at[texts] + step, ends[texts])
                reach = np.minimum(highs + self.longest - 1, ends[texts])
                size = reach - at[texts]
                stops = np.cumsum(size)
                shift = at[texts] - (stops - size)
                part = points[np.repeat(shift, size) + np.arange(stops[-1])]
                for number, start, distance, rotation in self.search(part, stops, block):
                    owner = np.searchsorted(stops, start, "right")
                    start = start + shift[owner]
                    inside = start < highs[owner]
                    found.append(np.stack([texts[owner], start, number, distance, rotation])[:, inside])
                looked += int((highs - at[texts]).sum())
                at[texts] = highs
            text, start, number, _, _ = rows = np.concatenate(found, axis=1)
            place = start + self.sizes[number] if by_end else start
            # The place of each text at which it may stop, if all that could come before it has been looked at.
            pairs = np.unique(np.stack([text, place]), axis=1) if len(text) else np.empty((2, 0), np.int64)
            turn = np.arange(pairs.shape[1]) - np.searchsorted(pairs[0], pairs[0])
            last = np.full(len(ends), np.iinfo(np.int64).max)
            last[pairs[0][turn == stop - 1]] = pairs[1][turn == stop - 1]
            found = [rows[:, place <= last[text]]]
            done = last < at + (self.shortest if by_end else 0)
            open_ = open_[~done[open_] & (at[open_] < ends[open_])]
            step = min(4 * step, block)
        _, start, number, distance, rotation = found[0]
        return (number, start, distance, rotation), looked

    def _hits(self, sums):
        """(place, pattern, offset) of the seeds that stand in hashed points, by size; how many there are first."""
        import numpy as np

        found, total = [], 0
        for size, (known, keys, numbers, offs) in self.seeds.items():
            if len(sums) <= size:
                continue
            hashes = Hasher.windows(sums, size)
            places = np.flatnonzero(known[hashes >> np.uint64(48)])
            left = np.searchsorted(keys, hashes[places], "left")
            count = np.searchsorted(keys, hashes[places], "right") - left
            total += int(count.sum())
            found.append((size, places[count > 0], left[count > 0], count[count > 0], numbers, offs))
        return total, found

    def _block(self, points, ends, low: int, high: int):
        """The matches that start from low to high; a block of too many hits is done in halves."""
        import numpy as np

        candidates = []
        if self.seeds:
            sums = Hasher.sums(points[low : high + self.longest - 1])
            total, found = self._hits(sums)
            if (total > HITS or len(self.scanned) * (high - low) > CELLS) and high - low > 1:
                for a, b in ((low, (low + high) // 2), ((low + high) // 2, high)):
                    yield from self._block(points, ends, a, b)
                return
            for size, places, left, count, numbers, offs in found:
                which = np.arange(count.sum()) + np.repeat(left - np.cumsum(count) + count, count)
                number, off, place = numbers[which], offs[which], np.repeat(places, count)
                keep = (place >= off) & (place - off < high - low) if not self.circular else np.ones(len(off), bool)
                far = keep & (self.sizes[number] >= LONG)
                if far.any():
                    keep[far] = self._promising(sums, number[far], place[far], off[far], size, ends - low)
                candidates.append((number[keep], place[keep] + low - off[keep]))
        if len(self.scanned):
            reach = np.where(self.circular, self.sizes[self.scanned] - 1, 0)
            count = high - low + reach
            starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low - np.repeat(reach, count)
            candidates.append((np.repeat(self.scanned, count), starts))
        if not candidates:
            return
        number, at = (np.concatenate(x) for x in zip(*candidates))
        span = high + 3 * self.longest
        number, at = np.divmod(np.unique(number * span + at + 2 * self.longest), span)
        number, start, distance, rotation = self._compared(number, at - 2 * self.longest, points, ends, low, high)
        if len(number):
            order = np.lexsort((rotation, distance, start, number))
            number, start, distance, rotation = number[order], start[order], distance[order], rotation[order]
            best = np.append(True, (number[1:] != number[:-1]) | (start[1:] != start[:-1]))
            yield number[best], start[best], distance[best], rotation[best]

    def _promising(self, sums, number, place, off, size: int, ends):
        """Whether a stretch of the pattern's length around each seed may have at most k mismatches: from the
        seed on, both sides are extended over mismatches by jumps, each a binary search over prefix hashes.
        Unequal stretches of equal hashes only let too many pass, which are compared anyway."""
        import numpy as np

        own, m, k = self.bases[number] + number + off, self.sizes[number], self.ks[number]
        down, text, pattern = Hasher.powers(max(len(sums), self.longest * 2))[1], sums, self.long_sums
        index = np.searchsorted(ends, place, "right")
        begin = np.maximum(np.where(index > 0, ends[np.maximum(index - 1, 0)], 0), 0)
        right = np.minimum(np.minimum(self.lengths[number] - off, ends[index] - place), len(sums) - 1 - place)
        left = np.minimum(off, place - begin)

        def agree(side, gone, room):
            """How far text and pattern agree from `gone` characters beside the seed's start on, within room."""
            low, high = np.zeros(len(gone), np.int64), np.maximum(room - gone, 0)
            while (unsure := low < high).any():
                mid = np.where(unsure, (low + high + 1) // 2, low)
                a, b = (place + gone, place + gone + mid) if side > 0 else (place - gone - mid, place - gone)
                shift = own - place
                at = off + (a - place)
                same = (text[b] - text[a]) * down[a] == (pattern[b + shift] - pattern[a + shift]) * down[at]
                low, high = np.where(unsure & same, mid, low), np.where(unsure & ~same, mid - 1, high)
            return low

        ext = {}
        for side, room in ((1, right), (-1, left)):
            gone, ext[side] = np.where(side > 0, np.minimum(size, room), 0), []
            for _ in range(int(k.max()) + 1):
                gone = gone + agree(side, gone, room)
                ext[side].append(gone)
                gone = np.minimum(gone + 1, room)
        out = np.zeros(len(number), bool)
        for i in range(int(k.max()) + 1):
            rest = np.maximum(k - i, 0)
            reach = np.choose(rest, ext[1]) if len(ext[1]) <= 31 else np.array(ext[1])[rest, np.arange(len(rest))]
            out |= (i <= k) & (ext[-1][i] + reach >= m)
        return out

    def _compared(self, number, at, points, ends, low: int, high: int):
        import numpy as np

        out = [np.empty((4, 0), np.int64)]
        lengths = self.lengths[number]
        for length in np.unique(lengths).tolist():
            own = lengths == length
            numbers, places = number[own], at[own]
            m = (length + 1) // 2 if self.circular else length
            if not self.circular:
                inside = (places >= low) & (places < high)
                inside[inside] = places[inside] + m <= ends[np.searchsorted(ends, places[inside], "right")]
                numbers, places = numbers[inside], places[inside]
            for i in range(0, len(places), rows := max(1, CELLS // length)):
                n, a = numbers[i : i + rows], places[i : i + rows]
                wrong = points.take(a[:, None] + np.arange(length), mode="clip") != self.flat[self.bases[n][:, None] + np.arange(length)]
                if not self.circular:
                    distance = wrong.sum(1)
                    good = distance <= self.ks[n]
                    out.append(np.stack([n[good], a[good], distance[good], np.zeros(good.sum(), np.int64)]))
                    continue
                sums = np.zeros((len(a), length + 1), np.int32)
                np.cumsum(wrong, axis=1, out=sums[:, 1:])
                distance = sums[:, m:] - sums[:, :-m]
                row, rotation = np.nonzero(distance <= self.ks[n][:, None])
                start = a[row] + rotation
                inside = (start >= low) & (start < high)
                inside[inside] = start[inside] + m <= ends[np.searchsorted(ends, start[inside], "right")]
                row, rotation, start = row[inside], rotation[inside], start[inside]
                out.append(np.stack([n[row], start, distance[row, rotation], rotation]))
        return np.concatenate(out, axis=1)


def _slices(batches, most: int = SLICE_BYTES):
    """Batches of rows whose texts take about `most` bytes, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spread(texts: DataFrame) -> DataFrame:
    """The texts in as many parts as the cluster has cores; those of a large table are not moved."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def ranges(texts: DataFrame, size: int, behind: int, columns: list[str]) -> DataFrame:
    """The columns of texts (text, ...) with (base, owned, text) of each range of `size` characters: its text
    begins at base, owns its first `owned` characters and goes on for at most `behind` more. A text is one
    row, so it is cut where it is read."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches):
        def out(batch, rows):
            which, bases, owned, pieces = zip(*rows)
            place = [pa.array(bases, pa.int64()), pa.array(owned, pa.int64()), pa.array(pieces)]
            return pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(which)) for c in columns), *place], [*columns, "base", "owned", "text"])

        for batch in _slices(batches):
            rows, held = [], 0
            for i, text in enumerate(batch["text"].to_pylist()):
                for base in range(0, len(text or ""), size):
                    rows.append((i, base, min(size, len(text) - base), text[base : base + size + behind]))
                    held += len(rows[-1][-1])
                    if held >= SLICE_BYTES:
                        yield out(batch, rows)
                        rows, held = [], 0
            if rows:
                yield out(batch, rows)

    return texts.select(*columns, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", base long, owned long, text string")


COLUMNS = "pos long, distance int, rotation int, size int"


def _thresholds(patterns: DataFrame, k: int | None) -> DataFrame:
    """(pattern_id, pattern, k) of the patterns that are not empty, with a threshold of their own for k None."""
    own = F.col("k").cast("int") if k is None else F.lit(k).cast("int")
    return patterns.select("pattern_id", "pattern", own.alias("k")).where("length(pattern) > 0 AND k IS NOT NULL")


def _broadcast(texts: DataFrame, wanted: Patterns, names: pa.Array, kind: str, block_size: int, range_size: int | None, stop: int | None, by_end: bool) -> DataFrame:
    """(row, text_id, pattern_id, pos, distance, rotation, size) by one pass over the texts."""
    shared = texts.sparkSession.sparkContext.broadcast((wanted, names))

    def run(batches):
        import numpy as np

        wanted, names = shared.value
        for batch in _slices(batches):
            rows = [t or "" for t in batch["text"].to_pylist()]
            lengths = np.array([len(t) for t in rows], np.int64)
            ends, bases, owned = np.cumsum(lengths), batch["base"].to_numpy(), batch["owned"].to_numpy()
            points = codes("".join(rows))
            found = wanted.search(points, ends, block_size) if stop is None else [wanted.first(points, ends, block_size, stop, by_end)[0]]
            for number, start, distance, rotation in found:
                text = np.searchsorted(ends, start, "right")
                place = start - (ends - lengths)[text]
                if (place >= owned[text]).any():
                    keep = place < owned[text]
                    number, text, place, distance, rotation = number[keep], text[keep], place[keep], distance[keep], rotation[keep]
                take = pa.array(text)
                columns = [batch["row"].take(take), batch["text_id"].take(take), names.take(pa.array(number)), pa.array(place + bases[text]), pa.array(distance.astype(np.int32)), pa.array(rotation.astype(np.int32)), pa.array(wanted.sizes[number].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text_id", "pattern_id", "pos", "distance", "rotation", "size"])

    schema = f"row long, text_id {texts.schema['text_id'].dataType.simpleString()}, pattern_id {kind}, {COLUMNS}"
    short = spread(texts if range_size is None else texts.where(f"length(text) <= {range_size}")).select(F.lit(None).cast("long").alias("row"), "text_id", F.lit(0).cast("long").alias("base"), F.length("text").cast("long").alias("owned"), "text")
    long = None if range_size is None else texts.where(f"length(text) > {range_size}")
    if long is None or long.isEmpty():
        return short.mapInArrow(run, schema)
    long = long.withColumn("row", F.monotonically_increasing_id())
    parts = texts.sparkSession.sparkContext.defaultParallelism
    long = ranges(long, range_size, wanted.longest - 1, ["row", "text_id"]).repartition(parts, "row", "base")
    found = long.mapInArrow(run, schema)
    return _stopped(found, stop, by_end).unionByName(short.mapInArrow(run, schema))


def _stopped(found: DataFrame, stop: int | None, by_end: bool) -> DataFrame:
    """The first places of a text of those that its ranges found first."""
    if stop is None:
        return found
    place = F.expr("pos + size") if by_end else F.col("pos")
    return found.withColumn("turn", F.dense_rank().over(Window.partitionBy("row").orderBy(place))).where(f"turn <= {stop}").drop("turn")


def _matches(texts: DataFrame, patterns: DataFrame, k: int | None, circular: bool, block_size: int, strategy: str, range_size: int | None, stop: int | None = None, by_end: bool = False) -> DataFrame:
    if (k is not None and k < 0) or block_size < 1 or (range_size is not None and range_size < 1) or strategy not in ("seeds", "scan", "join") or (stop is not None and stop < 1):
        raise ValueError("k must not be negative, sizes and stop_after must be positive and strategy seeds, scan or join")
    texts, patterns = encoded(texts.select("text_id", "text"), patterns)
    patterns, texts = _thresholds(patterns, k), texts.where("length(text) > 0")
    none = F.lit(0)
    size, longest, least = patterns.agg(F.coalesce(F.sum(F.length("pattern") + 16), none), F.coalesce(F.max(F.length("pattern")), none), F.coalesce(F.min("k"), none)).first()
    if longest > block_size:
        raise ValueError("a pattern is longer than block_size")
    if least < 0:
        raise ValueError("k must not be negative")
    kind = patterns.schema["pattern_id"].dataType.simpleString()
    if strategy == "join" or strategy == "seeds" and size > PATTERN_CHARS:
        if stop is not None:
            raise ValueError("patterns that are joined cannot stop a text early")
        from motifspark.operators.seed_join import seed_join

        # What has at most k characters matches everywhere, and has no seeds.
        out, patterns, strategy = seed_join(texts, patterns.where("length(pattern) > k"), circular, longest), patterns.where("length(pattern) <= k"), "scan"
        size = patterns.agg(F.coalesce(F.sum(F.length("pattern") + 16), none)).first()[0]
    else:
        out = None
    groups = -(-size // PATTERN_CHARS)
    for group in range(groups if out is not None else max(1, groups)):
        # One group, but for tables of patterns that can only be scanned for.
        own = (patterns if groups <= 1 else patterns.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(groups)) == group)).toArrow()
        wanted = Patterns(own["pattern"].to_pylist(), own["k"].to_numpy(), circular, strategy == "scan")
        found = _broadcast(texts, wanted, own["pattern_id"].combine_chunks(), kind, block_size, range_size, stop, by_end).drop("row")
        out = found if out is None else out.unionByName(found)
    return out


def kmismatch(texts: DataFrame, patterns: DataFrame, k: int | None, circular: bool = False, block_size: int = BLOCK, strategy: str = "seeds", range_size: int | None = RANGE, stop_after: int | None = None) -> DataFrame:
    """Rows (text_id, pattern_id, pos, distance[, rotation]) of every start at which a pattern (circular:
    a rotation of it) occurs with at most k mismatches; of several rotations the best, then smallest.

    texts (text_id, text) and patterns (pattern_id, pattern) may have other columns. Symbols are code
    points; both sides may also be binary, compared by bytes, or arrays of one type, whose elements are
    the symbols (see symbols.py). Positions start at 0. With k None each pattern has a threshold of its own
    in its column `k`; patterns of a null one give no rows. Null or empty texts and patterns, and patterns
    longer than a text, give no rows; rows of repeated or null ids are searched each for itself.

    Strategy "scan" compares every start, as always for patterns of at most k characters; "seeds"
    candidates only; "join" joins seeds of patterns and texts by a shuffle, as "seeds" does by itself for
    patterns of more than PATTERN_CHARS characters. Rows are the same for every strategy, block_size,
    the number of starts that a task looks at together, and range_size, the number of starts of a text that
    go to one task (None: no text is cut, nor looked at for its length first); a pattern longer than block_size raises ValueError, as does a negative k. With
    stop_after=n a text is read until its nth start with a match: rows of its first n such starts.
    """
    found = _matches(texts, patterns, k, circular, block_size, strategy, range_size, stop_after)
    return found.select("text_id", "pattern_id", "pos", "distance", *(["rotation"] if circular else []))


def multi_pattern_scan(texts: DataFrame, patterns: DataFrame, block_size: int = BLOCK, strategy: str = "seeds", range_size: int | None = RANGE, stop_after: int | None = None) -> DataFrame:
    """(text_id, pattern_id, pos, end_pos) of every exact occurrence of every pattern, suffixes of other
    patterns included; end_pos is exclusive. With stop_after=n, those that end at a text's first n places
    at which any ends, and the text is read no further. All else as kmismatch."""
    found = _matches(texts, patterns, 0, False, block_size, strategy, range_size, stop_after, by_end=True)
    return found.select("text_id", "pattern_id", "pos", (F.col("pos") + F.col("size")).alias("end_pos"))
