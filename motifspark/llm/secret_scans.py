"""Secret scans (operator 6): base patterns and multipart credential linking, in DataFrame functions only.

Strong patterns are reported always. Weak candidates (access identifiers, secrets, endpoints) are
reported only where complementary parts co-occur within a scope of SCOPE code points: an interval
semi-join on (document, bin of SCOPE code points) with a distance check, so no pair is emitted. Parts
that overlap are no complements, and what begins inside an endpoint is a piece of it and no part.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, packed, table, unpacked

#: Base kinds in the order in which ties are listed: pattern, and length that group `g` must have.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs below the least length are never matches, and a run holds no match besides itself.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Weak kinds: pattern, and the part of a credential that it is. What an endpoint's scheme may be is bounded,
#: and keys begin where their run does, so no pattern reads a long run again from each of its characters.
WEAK = [
    ("identifier", r"""\b(?i:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 1, 3),
    ("key", r"""(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}""", 0, 20),
    ("endpoint", r"""\b(?:[a-z][a-z0-9+]{0,15}://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]+)""", 0, 8),
]
#: Part that each kind is, and the parts of which one must be near for a weak candidate.
PART = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
NEEDS = {"identifier": ["secret"], "key": ["identifier", "endpoint"], "endpoint": ["secret"]}
SCOPE = 200
ORDER = ["assign", "access", "hex", "identifier", "key", "endpoint"]

_SPAN = "struct<start:long,rank:int,end:long>"


def spans_of(text: str, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<(start, rank, end)> of the leftmost non-overlapping matches of a pattern in the column
    `text` whose group has the least length. Places follow from the lengths of the texts between
    the matches, in one pass."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rank = ORDER.index(kind)
    pieces = f"transform(split({text}, {quoted}, -1), p -> length(p))"
    sizes = f"regexp_extract_all({text}, {quoted}, 0)"
    groups = f"regexp_extract_all({text}, {quoted}, {group})"
    new = f"named_struct('start', a.at + z['0'], 'rank', {rank}, 'end', a.at + z['0'] + z['1'])"
    return F.expr(f"""CASE WHEN {text} RLIKE {quoted} THEN aggregate(
        arrays_zip({pieces}, transform({sizes}, m -> length(m)), transform({groups}, g -> length(g))),
        named_struct('at', 0L, {_empty(_SPAN)}),
        (a, z) -> named_struct('at', a.at + z['0'] + coalesce(z['1'], 0), {_appended(new, f"z['2'] >= {least}")}),
        a -> {_ALL}) ELSE CAST(array() AS array<{_SPAN}>) END""")


#: Arrays grow in an aggregate by copies, so new elements go to a buffer of at most this many first.
_BUFFER = 256
_ALL = "flatten(concat(a.out, array(a.buf)))"


def _empty(kind: str) -> str:
    return f"'buf', CAST(array() AS array<{kind}>), 'out', CAST(array() AS array<array<{kind}>>)"


def _appended(new: str, wanted: str = "true") -> str:
    """The fields buf and out of the accumulator `a` with a new element, if it is wanted."""
    full = f"size(a.buf) >= {_BUFFER}"
    return f"""'buf', CASE WHEN NOT coalesce({wanted}, false) THEN a.buf WHEN {full} THEN array({new}) ELSE concat(a.buf, array({new})) END,
          'out', CASE WHEN coalesce({wanted}, false) AND {full} THEN concat(a.out, array(a.buf)) ELSE a.out END"""


def scanned(docs: DataFrame, scope: int = SCOPE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) as the struct `_own`, base and spans, see scan()."""
    text = "_scanned"
    rows = docs.select(packed(docs.columns if keep is None else keep), F.coalesce(F.col(text_col), F.lit("")).alias(text), F.expr("uuid()").alias("row"))
    rows = rows.withColumns({k: spans_of(text, k, p, g, n) for k, p, g, n in BASE + WEAK}).drop(text)
    base = F.array_sort(F.concat(*(F.col(k) for k, *_ in BASE)))
    rows = cut(rows.select("_own", "row", base.alias("base"), F.concat(*(F.col(k) for k, *_ in WEAK)).alias("weak")))

    places = rows.where("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    part = reduce(lambda c, k: c.when(F.col("rank") == ORDER.index(k), PART[k]), ORDER, F.when(F.lit(False), ""))
    places = places.withColumn("part", part).withColumn("bin", F.expr(f"start div {scope}"))
    ends = places.where("part = 'endpoint'").select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"(end - 1) div {scope}"))).alias("b"))
    places = places.join(ends, F.expr("row = r AND bin = b AND part <> 'endpoint' AND s <= start AND start < e"), "left_anti")
    # A span stands in each bin that it, widened by the scope, touches; a candidate in its own only.
    others = places.select("row", "part", "start", "end", F.explode(F.sequence(F.expr(f"greatest(0L, start - {scope}) div {scope}"), F.expr(f"(end + {scope}) div {scope}"))).alias("bin"))
    linked = None
    for kind, needs in NEEDS.items():
        weak = places.where(F.col("rank") == ORDER.index(kind))
        near = others.where(F.col("part").isin(needs)).select(F.col("row").alias("r"), F.col("bin").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
        found = weak.join(near, F.expr(f"row = r AND bin = b AND s < end + {scope} AND e > start - {scope} AND (s >= end OR e <= start)"), "left_semi")
        linked = found if linked is None else linked.unionByName(found)
    linked = linked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))
    # Rows without weak candidates are not shuffled.
    out = rows.where("size(weak) > 0").join(linked, F.col("row") == F.col("_row"), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"CAST(array() AS array<{_SPAN}>)"))))
    return out.select("_own", "base", spans.alias("spans")).unionByName(rows.where("size(weak) = 0").select("_own", "base", F.col("base").alias("spans")))


def scan(docs: DataFrame, scope: int = SCOPE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), base (array of (start, rank, end) of the base
    kinds, by start, then kind) and spans (those and the linked weak ones). Rank is the place in
    ORDER; places are code points, ends exclusive.

    A null or empty text has no spans. Repeated rows and null ids are kept. A new column whose name
    `keep` has already gets an underscore behind it. An empty input gives no rows.
    """
    columns = docs.columns if keep is None else keep
    return unpacked(scanned(docs, scope, text_col, columns), columns, ["base", "spans"])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span in its text replaced by a mark; other columns stay, whatever their names."""
    rows = scanned(docs, text_col=text_col)
    return rows.select(*(redact(f"_own.`{c}`", "spans").alias(c) if c == text_col else F.col("_own")[c].alias(c) for c in docs.columns))


#: Code points of the pieces from which redact() takes what stands between two spans.
_PIECE = 4096


def redact(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by the mark; null stays null."""
    merged = f"""aggregate({spans}, named_struct({_empty("struct<s:bigint,e:bigint>")}),
      (a, x) -> CASE WHEN size(a.buf) > 0 AND x.start < element_at(a.buf, -1).e
        THEN named_struct('buf', concat(slice(a.buf, 1, size(a.buf) - 1), array(named_struct('s', element_at(a.buf, -1).s, 'e', greatest(element_at(a.buf, -1).e, x.end)))), 'out', a.out)
        ELSE named_struct({_appended("named_struct('s', x.start, 'e', x.end)")}) END, a -> {_ALL})"""
    between = lambda start, end: f"substring(array_join(slice(p, CAST({start} div {_PIECE} + 1 AS INT), CAST(({end} - 1) div {_PIECE} - {start} div {_PIECE} + 1 AS INT)), ''), CAST({start} % {_PIECE} + 1 AS INT), CAST({end} - {start} AS INT))"
    piece = f"CASE WHEN x.s > a.at THEN {between('a.at', 'x.s')} ELSE '' END"
    return F.expr(f"""CASE WHEN {text} IS NULL OR size({spans}) = 0 THEN {text} ELSE transform(array(regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)), p -> aggregate(
      {merged}, named_struct('at', 0L, {_empty("string")}),
      (a, x) -> named_struct('at', x.e, {_appended(f"concat({piece}, '{mark}')")}),
      a -> concat(array_join({_ALL}, ''), CASE WHEN a.at < length({text}) THEN {between('a.at', f'length({text})')} ELSE '' END)))[0] END""")


def listing(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in ORDER) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.rank + 1), ':', s.start, ':', s.end)), ',')")


def op6_secret_scans(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda rank: F.expr(f"CAST(size(filter(base, s -> s.rank = {rank})) AS LONG)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))


def secret_base_spans(spark, sf_dir):
    """The columns of op6_secret_scans that SQL can express."""
    return op6_secret_scans(spark, sf_dir).drop("spans")


def _matches(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL of a base kind's matches with the text before each. Letters of either case are spelt out, as
    DuckDB's own flag would add letters beyond ASCII."""
    either = re.sub(r"\(\?i:(.*?)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)
    quoted = "'" + either.replace("'", "''") + "'"
    columns = f"unnest(string_split_regex(text, {quoted})) AS gap, unnest(regexp_extract_all(text, {quoted})) AS m, unnest(regexp_extract_all(text, {quoted}, {group})) AS g"
    return f"SELECT doc_id, '{kind}' AS kind, {ORDER.index(kind)} AS rank, {least} AS least, {columns}, unnest(range(len(text) + 1)) AS i FROM t WHERE regexp_matches(text, {quoted})"


BASE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches(*base) for base in BASE)}),
p AS (SELECT doc_id, kind, rank, least, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m WHERE m IS NOT NULL),
s AS (SELECT doc_id, kind, rank, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS {name}" for i, name in enumerate(("n_assign", "n_access", "n_hex")))}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce({name}, 0) AS {name}" for name in ("n_assign", "n_access", "n_hex"))}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN a USING (doc_id)"""
