"""N-gram Jaccard join (operator 4): exact, by Voronoi regions of pivots in the Jaccard metric.

Nearly all documents are at distance 1 from any pivot, so what cannot link goes first: two sets of
similarity s share at least s of either one's shingles, so a set with more shingles of its own than
the rest allows links with nothing. Rounds over a growing part of the shingles find these sets.

What is left is joined by regions. Linked sets share a shingle of their prefixes, so the sets of each
such shingle are a region to begin with. Let t = 1 - s. Each region has pivots, and every set in it is
measured to them. A set within t of pivots links with them, and the Voronoi region of the nearest one
owns it. By the triangle inequality, a set that links with an owned one is within 2t of its pivot, and
their distances to it differ by at most t: within these windows, boundary sets that are not connected
yet are replicated into the pivot's region. That region is then joined in the same way, owned against
boundary sets; the sets that no pivot owns stay in the old region for its next round, until no region
has unconnected parts. Rounds take more and more pivots, so their number grows with the logarithm of
a region's size.

Prefixes take the rarest shingles first, by exact counts. Shingles count as equal if their 64-bit
hashes are; a word's hash mixes eight bytes after eight bytes, for all words of a slice of texts at once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm import common
from motifspark.llm.common import discard, lookup, release, sliced, table

SHINGLE, PERCENT = 4, 85
#: Longest word in bytes that is hashed together with others, eight bytes of each at a time.
LONG_WORD = 256
#: Set keys by which a worker leaves out repeats.
SEEN = 300_000
#: The first round takes this multiple of the share of shingles in which linked sets may differ.
SAMPLE = 1.75
#: Rows, by count, of a table that may be broadcast.
FEW = 50_000
#: A round compares all that is left if its regions hold at most so many pairs, of which as many may link.
MEETINGS, PAIRS = 1 << 24, 200_000
#: Factors of the mixing steps.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def cut(df: DataFrame) -> DataFrame:
    """common.cut() of a table that grows with the input: joins shuffle it. Spark would broadcast it by its
    files' size, and what is made of it by the size before its arrays are exploded."""
    table = common.cut(df)
    out = table.hint("merge")
    out._cut = table._cut
    return out


def few(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, to be broadcast if they are few."""
    return F.broadcast(df) if n <= FEW else df


def _mixed(values):
    import numpy as np

    for factor, shift in zip(MIX, (29, 32)):
        values = values * np.uint64(factor)
        values ^= values >> np.uint64(shift)
    return values


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of each text of a slice."""

    def __init__(self, size: int):
        import numpy as np

        self.size = size
        self.blank, self.lower = np.zeros(256, bool), np.frombuffer(_LOWER, np.uint8)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.first = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def words(self, data, ends):
        """Hashes of the words of texts that stand one after the other in data and end at `ends`, and how
        many words each text has."""
        import numpy as np
        import xxhash

        apart = self.blank[data]
        starts = ~apart
        starts[1:] &= apart[:-1]
        firsts = np.concatenate([[0], ends[:-1]])
        inside = firsts[firsts < len(data)]
        starts[inside] = ~apart[inside]
        starts = np.flatnonzero(starts)
        # A word ends at a blank, at the next word's start or at the end.
        blanks = np.flatnonzero(apart)
        place = np.searchsorted(blanks, starts)
        stops = np.where(place < len(blanks), blanks[np.minimum(place, len(blanks) - 1)] if len(blanks) else len(data), len(data))
        stops = np.minimum(stops, np.append(starts[1:], len(data)))
        sizes = stops - starts
        low = np.append(self.lower[data], np.zeros(8, np.uint8))
        eight = np.ndarray(len(data) + 1, np.dtype("<u8"), low, strides=(1,))
        # Each step mixes the next eight bytes into a word's hash; its length stands at the beginning.
        out = sizes.astype(np.uint64)
        at = np.flatnonzero(sizes <= LONG_WORD)
        place, left = starts[at], sizes[at]
        while len(at):
            out[at] = _mixed(out[at] ^ (eight[place] & self.first[np.minimum(left, 8)]))
            more = left > 8
            at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : stops[i]])
        counts = np.searchsorted(starts, ends) - np.searchsorted(starts, firsts)
        return _mixed(out), counts

    def hashes(self, texts: pa.Array) -> list:
        """One array for each text; null texts and texts without words have none."""
        import numpy as np

        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        words, counts = self.words(data, offsets[1:] - offsets[0]) if len(data) else (np.empty(0, np.uint64), np.zeros(len(texts), np.int64))
        grams = np.full(max(0, len(words) - self.size + 1), self.size, np.uint64)
        for i in range(self.size):
            grams = _mixed(grams ^ words[i : i + len(grams)])
        out, start = [], 0
        for n in counts.tolist():
            if n >= self.size:
                own = np.sort(grams[start : start + n - self.size + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                whole = np.full(1, n, np.uint64)
                for word in words[start : start + n]:
                    whole = _mixed(whole ^ word)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
            start += n
        return out


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _key(hashes) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _lists(values):
    import numpy as np

    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)))


def _members(rows: DataFrame, size: int, share: float) -> DataFrame:
    """(id, n, key, k, sample) of each row: k is the key's first half, sample the shingles whose hash is in
    the lowest `share` of all; in a task, repeats have no sample as far as SEEN goes."""
    import numpy as np

    bound = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def run(batches):
        shingler, seen = Shingler(size), set()
        for batch in sliced(batches, 1):
            n, keys, halves, samples = [], [], [], []
            for hashes in shingler.hashes(batch.column(1)):
                key = _key(hashes) if len(hashes) else None
                n.append(len(hashes))
                keys.append(key)
                halves.append(int.from_bytes(key[:8], "big", signed=True) if key else None)
                samples.append(hashes[: 0 if key in seen else np.searchsorted(hashes, bound, "right")])
                if key and len(seen) < SEEN:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.int64()), _lists(samples)], ["id", "n", "key", "k", "sample"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, key binary, k long, sample array<long>")


#: log2 of the bits of the filter of wanted keys; what passes it by chance is left to an exact join.
FILTER_BITS = 25


def _filter(wanted: DataFrame):
    """Which places of the keys are taken, as bytes of bits; at most 2^FILTER_BITS / 64 rows reach the driver."""
    import numpy as np

    place = f"shiftright(CAST(conv(hex(substring(key, 1, 4)), 16, 10) AS BIGINT), {32 - FILTER_BITS})"
    found = wanted.select(F.expr(place).alias("h")).groupBy(F.expr("h DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _sets(rows: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(key, n, k, hashes) of the sets whose key is wanted, once each."""
    bits = rows.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches):
        shingler, seen = Shingler(size), set()
        for batch in sliced(batches, 1):
            keys, values = [], []
            for hashes in shingler.hashes(batch.column(1)):
                if not len(hashes) or (key := _key(hashes)) in seen:
                    continue
                at = int.from_bytes(key[:4], "big") >> (32 - FILTER_BITS)
                if bits.value[at >> 3] >> (at & 7) & 1:
                    keys.append(key)
                    values.append(hashes)
                    if len(seen) < SEEN:
                        seen.add(key)
            halves = [int.from_bytes(k[:8], "big", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([len(v) for v in values], pa.int64()), pa.array(halves, pa.int64()), _lists(values)], ["key", "n", "k", "hashes"])

    found = rows.mapInArrow(run, "key binary, n long, k long, hashes array<long>")
    return cut(found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "k", "hashes"))))


def _possible(sets: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The sets of which enough shingles are not their own, with the number `u` of those that are: own has
    (k, u). Where two keys share a k, both stay."""
    alone = sets.groupBy("k").agg(F.count("*").alias("keys"))
    rows = sets.join(alone, "k").join(own, "k", "left").withColumn("u", F.when(F.col("keys") == 1, F.coalesce("u", F.lit(0))).otherwise(0))
    return rows.where(f"u <= n - (({percent} * n + 99) div 100)").drop("keys")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) of the keys of edges (a, b): comp is the smallest key reachable. Labels take the
    smallest of their neighbours' and then their label's label, so long chains take few rounds."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp"))
    labels = cut(labels)
    n = labels.count()
    while True:
        near = both.join(few(labels.withColumnRenamed("key", "b"), n), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        hop = labels.select(F.col("key").alias("comp"), F.col("comp").alias("far"))
        new = cut(labels.join(few(near, n), "key").join(few(hop, n), "comp").select("key", F.col("comp").alias("old"), F.least("comp", "near", "far").alias("comp")))
        done = new.where("old <> comp").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return labels.select("key", "comp")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (key, comp) after the components `links` (key, comp) of components, which may be single keys."""
    moved = few(links.select(F.col("key").alias("comp"), F.col("comp").alias("to")), links.count())
    old = comps.join(moved, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp"))
    return cut(old.unionByName(links.join(few(comps.select("key"), comps.count()), "key", "left_anti").select("key", "comp")))


#: Pivots of a region in its first round, and how many times more there are in each further one.
PIVOTS, MORE = 1, 4


def _linked(sets: DataFrame, tokens: DataFrame, percent: int) -> DataFrame | None:
    """(key, comp) of the sets that link with others, by Voronoi regions; tokens (token, key, n, i, w) are
    the shingles of the sets' prefixes. A row of a region is a set in it; `side` is 1 for what the
    region's own pivot owns and 0 for its boundary, which are joined with each other, and null where
    all are joined with all; d is the distance to that pivot."""
    t, wide = 1 - percent / 100 + 1e-9, max(0, 2 * percent - 100)
    linked = F.expr(f"100 * same >= {percent} * all")
    # In the region of its first shared shingle, a pair has at most the rest of either set in common.
    short = F.bool_or(F.expr(f"{100 + percent} * (n - i) >= {2 * percent} * n"))
    sized = "100 * least(n, pn) >= {0} * greatest(n, pn)"
    whole = sized.format(wide) + " AND side IS NULL"
    ring = f"(side = 1 AND d >= pd - {t}D OR side = 0 AND d <= pd + {t}D)"
    near = f"comp <> pcomp AND {sized.format(percent)} AND {100 + percent} * least(n - i, pn - pi) >= {percent} * (n + pn)"
    part = f"side <> pside AND {ring} AND {near}"
    every = f"(side IS NULL AND pside IS NULL OR side <> pside AND {ring}) AND {near} AND (key < p OR pcomp = most)"
    rows = tokens.select(F.col("token").alias("cell"), "key", "n", "i", "w", F.lit(None).cast("int").alias("side"), F.lit(None).cast("double").alias("d"))
    comps, turn, count, tables = None, 0, PIVOTS, []

    def measure(met):
        """(key, p, same, all) of pairs, each measured once, whatever regions it stands in."""
        left = met.select("key", "p").distinct().join(sets.select("key", F.col("hashes").alias("a")), "key")
        both = left.join(sets.select(F.col("key").alias("p"), F.col("hashes").alias("b")), "p")
        same = both.select("key", "p", F.size(F.array_intersect("a", "b")).alias("same"), (F.size("a") + F.size("b")).alias("sum"))
        return same.select("key", "p", "same", (F.col("sum") - F.col("same")).alias("all"))

    def joined(comps, found):
        """comps and the components of the linked ones of found (comp, pcomp, linked)."""
        edges = cut(found.where("linked AND comp <> pcomp").select(F.col("comp").alias("a"), F.col("pcomp").alias("b")).distinct())
        if not edges.isEmpty():
            links = components(edges)
            comps = links if comps is None else _merged(comps, links)
        discard(edges)
        return comps

    while True:
        named = rows.withColumn("comp", F.col("key")) if comps is None else rows.join(few(comps, comps.count()), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        cells = named.groupBy("cell").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), short.alias("short"), F.count("side").alias("sided"), F.min(F.expr("IF(side = 0, d, NULL)")).alias("near"), F.max(F.expr("IF(side = 1, d, NULL)")).alias("far"))
        cells = cells.where(f"size > 1 AND c0 <> c1 AND short AND (sided = 0 OR far >= near - {t}D)").select("cell", "near", "far")
        here = named.join(cells.hint("merge"), "cell").where(f"side IS NULL OR side = 1 AND d >= near - {t}D OR side = 0 AND d <= far + {t}D").drop("near", "far")
        here = cut(here)
        if here.isEmpty():
            discard(here, *tables)
            return comps
        # After the first round few parts are left: the sets outside of a region's largest part meet all in it.
        # If too many, further rounds divide them.
        if turn:
            parts = here.groupBy("cell", "comp").agg(F.count("*").alias("size"))
            parts = cut(parts.groupBy("cell").agg(F.max_by("comp", "size").alias("most"), F.max("size").alias("top"), F.sum("size").alias("size")))
            n, meetings = parts.agg(F.count("*"), F.expr("sum(size * (size - top))")).first()
            if meetings <= MEETINGS:
                apart = here.join(few(parts.select("cell", "most"), n), "cell").where("comp <> most")
                others = here.select("cell", F.col("key").alias("p"), *(F.col(c).alias(f"p{c}") for c in ("n", "i", "side", "d", "comp")))
                met = cut(apart.join(others, "cell").where(every).select("key", "p", "comp", "pcomp").limit(PAIRS + 1))
                if met.count() <= PAIRS:
                    comps = joined(comps, met.join(measure(met), ["key", "p"]).withColumn("linked", linked))
                    discard(here, parts, met, *tables)
                    return comps
                discard(met)
            discard(parts)
        # First the set that differs least from others; then more, in another order each round.
        order = F.struct("w", "key") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)), "key")
        bucket = F.pmod(F.xxhash64("key", F.lit(-turn)), F.lit(count)).alias("bucket")
        chosen = here.groupBy("cell", bucket).agg(F.min_by(F.struct("key", "n", "i", "side", "d", "comp"), order).alias("x"))
        pivots = cut(chosen.select("cell", *(F.col(f"x.{c}").alias(f"p{c}") for c in ("key", "n", "i", "side", "d", "comp"))).withColumnRenamed("pkey", "p"))
        met = here.join(F.broadcast(pivots) if pivots.count() <= FEW else pivots, "cell").where(f"key <> p AND ({whole} OR {part})").select("cell", "key", "p", "side", "comp", "pcomp")
        met = cut(met)
        measured = cut(measure(met).where(f"100 * same >= {wide} * all"))
        found = cut(met.join(measured, ["key", "p"]).select("cell", "key", "p", "side", "comp", "pcomp", (1 - F.col("same") / F.col("all")).alias("e"), linked.alias("linked")))
        comps = joined(comps, found)
        # Regions of the next round: in a pivot's own region, what it owns against its boundary; in the old
        # one what no pivot owns; in one that has sides, all but the pivots.
        owned = found.where("linked AND side IS NULL").groupBy("cell", "key").agg(F.min(F.struct("e", "p")).alias("o")).select("cell", "key", "o.p", F.col("o.e").alias("e"))
        inner = owned.withColumn("to", F.lit(1))
        outer = found.where("NOT linked AND side IS NULL").select("cell", "key", "p", "e", F.lit(0).alias("to"))
        facts = here.select("cell", "key", "n", "i", "w")
        inside = inner.select("cell", "key", "p", "e", "to").unionByName(outer).join(facts, ["cell", "key"])
        inside = inside.select(F.xxhash64("cell", "p").alias("cell"), "key", "n", "i", "w", F.col("to").alias("side"), F.col("e").alias("d"))
        gone = owned.select("cell", "key").unionByName(pivots.select("cell", F.col("p").alias("key")))
        stay = here.join(gone, ["cell", "key"], "left_anti").select(*rows.columns)
        rows = cut(stay.unionByName(inside.select(*rows.columns)))
        discard(here, pivots, met, measured, found, *tables)
        release(rows.sparkSession)
        tables, turn, count = [rows], turn + 1, count * MORE


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A null text, or one without words, is linked with nothing and its component is its own id, also
    where such rows repeat. Rows of equal sets are linked, whatever their ids; null ids count for a
    component's id only where it has no other. Other columns are ignored. An empty input gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    members = cut(_members(rows, shingle, min(1.0, SAMPLE * (1 - percent / 100))))
    classes = cut(members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("k").alias("k")))
    # Shingles of the sample that stand in one set only, counted by set; common ones meet pre-aggregated.
    found = members.where("size(sample) > 0").select("k", F.explode("sample").alias("token"))
    single = found.groupBy("token").agg(F.min("k").alias("k"), F.max("k").alias("other")).where("k = other").groupBy("k").agg(F.count("*").alias("u"))
    wanted = cut(_possible(classes.select("key", "n", "k"), single, percent).select("key"))
    sets = _sets(rows, shingle, wanted)
    # All shingles of what is left.
    counts = cut(sets.select("k", F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.min("k").alias("k")))
    kept = cut(_possible(sets, counts.where("df = 1").groupBy("k").agg(F.count("*").alias("u")), percent))
    shared = kept.select("key", "n", "u", F.explode("hashes").alias("token")).join(counts.where("df > 1").select("token", "df"), "token")
    # A set's own shingles come first, as they are the rarest, but meet nothing.
    ordered = shared.groupBy("key", "n", "u").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    ordered = ordered.withColumn("s", F.expr(f"slice(s, 1, CAST(greatest(0L, n - (({percent} * n + 99) div 100) + 1 - u) AS INT))"))
    tokens = cut(ordered.select("key", "n", F.posexplode("s").alias("at", "s"), "u").select("s.token", "key", "n", (F.col("u") + F.col("at")).alias("i"), (F.col("u") / F.col("n")).alias("w")))
    release(docs.sparkSession)
    comps = _linked(kept, tokens, percent)
    discard(wanted, sets, counts, kept, tokens)
    named = classes.select("key", "first", "copies", F.col("key").alias("comp")) if comps is None else classes.join(comps, "key", "left").select("key", "first", "copies", F.coalesce("comp", "key").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("keys"))
    ids = lookup(named, least.hint("merge"), "comp", "keys", classes.count()).select("key", "copies", "component_id")
    members = members.select("id", "n", "key")
    out = lookup(members, ids.hint("merge"), "key", "copies", members.count())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
a AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS a FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[a : a + {SHINGLE - 1}], ' ') AS s FROM a),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= {PERCENT} * (x.n + y.n - same)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)"""
