"""Document fingerprints (operator 13): I-Match with randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band. A text keeps the terms that
the lexicon knows; each of SUBSETS random subsets of the lexicon gives one hash, that of the text's
sorted distinct terms in it. Texts that differ in a few terms agree in the subsets that none of these is in.

Whether a term is in a subset follows from the term's sha256, at a rate of 2^-level, and a subset of one
level holds that of the next. A text's level follows from its number of distinct terms: a subset of that
level holds two to four of them, one of the next level one or two, so texts of all lengths have subsets
that small edits leave alone. A fingerprint has the hashes of both levels.

Terms in no subset of a text's level are left out before anything is looked up, so at most some dozens of
terms a text are gathered. The lexicon's size is bounded by the texts' mean number of distinct terms over
LEAST_SHARE, whatever their number; it is broadcast where it has at most BROADCAST terms.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifspark.llm.common import cut, packed, table, unpacked

#: The band: terms that stand in at least and at most these shares of all texts.
LEAST_SHARE, MOST_SHARE = 1 / 1000, 1 / 2
#: Subsets of a level, and levels; each subset has four hexadecimal digits of a term's sha256.
SUBSETS, LEVELS = 14, 16
#: Hexadecimal digits of a subset's hash, and terms of a lexicon that is broadcast.
DIGITS, BROADCAST = 6, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms(text: str) -> Column:
    """Distinct terms of a text: A-Z lower-cased, runs of digits, a-z and what is not ASCII; none for null."""
    split = f"split(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_BETWEEN}')"
    return F.expr(f"array_remove(array_distinct({split}), '')")


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term) of the band over all rows of docs, null and empty texts included, written to a table."""
    n = docs.count()
    found = docs.select(F.explode(terms(f"`{text_col}`")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return cut(found.where(f"df >= {least!r}D * {n} AND df <= {most!r}D * {n}").select("term"))


def _by_level(values: list[str], level: str) -> str:
    """The value of a level; level 0 has the first."""
    return f"element_at(array({', '.join(map(repr, values))}), {level} + 1)"


#: What a subset's four digits must be below for a term to be in it: at level 0, all are.
_BOUNDS = ["g", *(f"{1 << 16 - i:04x}" for i in range(1, LEVELS + 1))]
#: What a sha256 matches if its term is in any subset of a level.
_ANY = ["", *(f"^(?:....){{0,{SUBSETS - 1}}}?{'0' * (i // 4)}{('', '[0-7]', '[0-3]', '[01]')[i % 4]}" for i in range(1, LEVELS + 1))]


def _bound_to(name: str, value: str, body: str) -> str:
    """An expression in which `name` stands for a value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hashed(picked: str, level: str, coarse: str, fine: str) -> str:
    """The fingerprint (level, coarse, fine) of the sorted picked terms, by the bounds of both levels; null if
    there are none."""
    subset = lambda terms, bound: f"filter({terms}, s -> substring(s.sha, 4 * r + 1, 4) < {bound})"
    digest = lambda s: f"CASE WHEN size({s}) = 0 THEN '' ELSE left(md5(array_join({s}.term, ' ')), {DIGITS}) END"
    both = _bound_to("c", subset("known", coarse), _bound_to("f", subset("c", fine), f"struct({digest('c')} AS coarse, {digest('f')} AS fine)"))
    hashes = f"transform(sequence(0, {SUBSETS - 1}), r -> {both})"
    known = f"CASE WHEN exists({picked}, s -> s.known) THEN filter({picked}, s -> s.known) ELSE {picked} END"
    whole = _bound_to("known", known, _bound_to("h", hashes, f"struct({level} AS level, h.coarse AS coarse, h.fine AS fine)"))
    return f"CASE WHEN size({picked}) > 0 THEN {whole} END"


def _fingerprints(rows: DataFrame, keys: list[str], texts: list[str], known: DataFrame) -> DataFrame:
    """rows (keys, _own, texts) with the fingerprints of the texts as structs f0, f1, ... in place of these."""
    numbers = range(len(texts))
    rows = rows.select(*keys, "_own", *(terms(f"`{t}`").alias(f"w{i}") for i, t in enumerate(texts)))
    rows = rows.withColumns({f"l{i}": F.expr(f"CAST(least({LEVELS - 1}, greatest(0, length(bin(size(w{i}))) - 2)) AS INT)") for i in numbers})
    rows = rows.withColumns({f"b{i}": F.expr(_by_level(_BOUNDS, f"l{i}")) for i in numbers} | {f"c{i}": F.expr(_by_level(_BOUNDS, f"l{i} + 1")) for i in numbers})
    facts = [f"{c}{i}" for c in "lbc" for i in numbers]
    # One more text without terms keeps the rows that have none.
    every = [f"struct({i} AS text, {_by_level(_ANY, f'l{i}')} AS member, w{i} AS terms)" for i in numbers] + ["struct(-1 AS text, '' AS member, array(CAST(NULL AS STRING)) AS terms)"]
    each = rows.select(*keys, "_own", *facts, F.explode(F.expr(f"array({', '.join(every)})")).alias("e"))
    each = each.select(*keys, "_own", *facts, "e.text", "e.member", F.explode("e.terms").alias("term")).withColumn("sha", F.sha2("term", 256))
    each = each.where("text = -1 OR sha RLIKE member")
    known = known.select(F.col("term").alias("_term"))
    found = each.join(F.broadcast(known) if known.count() <= BROADCAST else known, F.col("term") == F.col("_term"), "left")
    picked = lambda i: F.sort_array(F.collect_list(F.when((F.col("text") == i) & F.col("term").isNotNull(), F.struct("term", "sha", F.col("_term").isNotNull().alias("known")))))
    found = found.groupBy(*keys).agg(F.first("_own").alias("_own"), *(F.first(c).alias(c) for c in facts), *(picked(i).alias(f"p{i}") for i in numbers))
    return found.select(*keys, "_own", *(F.expr(_hashed(f"p{i}", f"l{i}", f"b{i}", f"c{i}")).alias(f"f{i}") for i in numbers))


def written(fingerprint: str) -> Column:
    """A fingerprint as text: level, hashes of the subsets, hashes of those of the next level; empty without terms."""
    return F.expr(f"coalesce(concat({fingerprint}.level, ':', array_join({fingerprint}.coarse, ','), ';', array_join({fingerprint}.fine, ',')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets in which either text has terms, at a level that both
    fingerprints have, the finer one; 1 for equal fingerprints, 0 where they have no level in common."""
    paired = lambda x, y: f"zip_with({a}.{x}, {b}.{y}, (x, y) -> struct(x AS x, y AS y))"
    none = "CAST(array() AS array<struct<x:string,y:string>>)"
    pairs = f"CASE {a}.level - {b}.level WHEN 0 THEN {paired('fine', 'fine')} WHEN -1 THEN {paired('fine', 'coarse')} WHEN 1 THEN {paired('coarse', 'fine')} ELSE {none} END"
    there = f"filter({pairs}, z -> z.x <> '' OR z.y <> '')"
    share = "CASE WHEN size(p) = 0 THEN 0.0D ELSE size(filter(p, z -> z.x = z.y)) / CAST(size(p) AS DOUBLE) END"
    return F.expr(f"CASE WHEN {a} <=> {b} THEN 1.0D WHEN {a} IS NULL OR {b} IS NULL THEN 0.0D ELSE {_bound_to('p', there, share)} END")


def fingerprinted(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and `fingerprint`, by the lexicon `known` (term), which is
    that of docs by default.

    Equal texts have equal fingerprints. A null text, or one without terms, has an empty one; one whose
    picked terms are all outside of the lexicon is hashed by these. Repeated rows stay; a column named
    fingerprint stays, and the new one gets an underscore behind it. No rows give none.
    """
    columns = docs.columns if keep is None else keep
    rows = docs.select(F.monotonically_increasing_id().alias("row"), packed(columns), F.col(text_col).alias("text"))
    found = _fingerprints(rows, ["row"], ["text"], lexicon(docs, text_col) if known is None else known)
    return unpacked(found.select("_own", written("f0").alias("fingerprint")), columns, ["fingerprint"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, at, copy, id, text, next) of docs (id, text) by ascending id, null ids last, equal ids by a
    hash of their text: next is the text of the next row, and of the first after the last. Rows stand in
    as many buckets as shuffles have partitions, ranges of equal sizes; `at` is a row's place in its bucket.
    The last row of a bucket meets the next bucket's first one in a copy of it, marked by `copy`."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key")
    ranges = docs.select(key).repartitionByRange(buckets, "key")
    firsts = sorted((r[0] for r in ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).select("key").collect()), key=lambda k: (k["none"], k["id"] if not k["none"] else 0, k["hash"]))
    kind = docs.schema[id_col].dataType
    bounds = [F.struct(F.lit(k["none"]).alias("none"), F.lit(k["id"]).cast(kind).alias("id"), F.lit(k["hash"]).alias("hash")) for k in firsts]
    step = isqrt(len(bounds)) + 1
    rows = docs.select(key, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if bounds:
        # How many firsts are not above a row's key: among each step-th, then among those that follow it.
        upto = lambda firsts: F.size(F.filter(firsts, lambda f: f <= F.col("key")))
        rows = rows.withColumn("group", upto(F.array(*bounds[::step])))
        groups = F.array(*(F.array(*bounds[i : i + step]) for i in range(0, len(bounds), step)))
        rows = rows.withColumn("own", F.element_at(groups, F.col("group")))
        rows = rows.withColumn("in", upto(F.col("own"))).withColumn("bucket", (F.col("group") - 1) * step + F.col("in") - 1)
        first = F.element_at("own", F.col("in")) == F.col("key")
        rows = rows.withColumn("before", F.when(first, F.pmod(F.col("bucket") - 1, F.lit(len(bounds)))))
    else:
        rows = rows.withColumns({"bucket": F.lit(0), "before": F.lit(None).cast("int")})
    own = F.struct("bucket", F.lit(False).alias("copy"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))))
    rows = rows.select("key", "id", "text", F.explode(places).alias("place")).select("key", "id", "text", "place.*")
    order = Window.partitionBy("bucket").orderBy("copy", "key")
    return rows.select("bucket", F.row_number().over(order).alias("at"), "copy", "id", F.col("text"), F.lead("text").over(order).alias("next"))


def op13_document_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    tail = "CAST(n_chars div 4 AS INT)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, CAST(n_chars AS INT) - {tail}), left(coalesce(next, ''), {tail}))"))
    own = F.struct("copy", F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256")).alias("_own")
    # The buckets' rows stay together, so fingerprints and their neighbours need no further shuffle.
    found = _fingerprints(rows.select("bucket", "at", own, "text", "edited"), ["bucket", "at"], ["text", "edited"], lexicon(docs))
    found = found.withColumn("f2", F.lead("f0").over(Window.partitionBy("bucket").orderBy("at"))).where("NOT _own.copy")
    return found.select("_own.doc_id", "_own.n_chars", "_own.edited_sha256", written("f0").alias("fingerprint"), written("f1").alias("edited_fingerprint"), likeness("f0", "f1").alias("near_edited"), likeness("f0", "f2").alias("near_next"))


def _sql() -> str:
    words = rf"list_filter(list_distinct(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), lambda x: x <> '')"
    inside = lambda level: f"substr(sha, 4 * n + 1, 4) < {_BOUNDS}[{level} + 1]"
    hashed = lambda level: f"coalesce(left(md5(string_agg(term, ' ' ORDER BY term) FILTER ({inside(level)})), {DIGITS}), '')"
    text = lambda f: f"coalesce({f}.level || ':' || array_to_string({f}.coarse, ',') || ';' || array_to_string({f}.fine, ','), '')"
    pairs = lambda a, b: f"CASE {a}.level - {b}.level WHEN 0 THEN list_zip({a}.fine, {b}.fine) WHEN -1 THEN list_zip({a}.fine, {b}.coarse) WHEN 1 THEN list_zip({a}.coarse, {b}.fine) ELSE [] END"
    there = lambda a, b: f"len(list_filter({pairs(a, b)}, lambda z: z[1] <> '' OR z[2] <> ''))"
    same = lambda a, b: f"len(list_filter({pairs(a, b)}, lambda z: z[1] <> '' AND z[1] = z[2]))"
    like = lambda a, b: f"CASE WHEN {text(a)} = {text(b)} THEN 1.0::DOUBLE WHEN {a}.level IS NULL OR {b}.level IS NULL OR {there(a, b)} = 0 THEN 0.0::DOUBLE ELSE CAST({same(a, b)} AS DOUBLE) / {there(a, b)} END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, count(*) OVER () AS total FROM documents),
e AS MATERIALIZED (SELECT d.r, d.doc_id, d.n, d.t, d.total, left(d.t, d.n - d.n // 4) || left(x.t, d.n // 4) AS edited FROM d JOIN d x ON x.r = d.r % d.total + 1),
w AS (SELECT r, which, {words} AS w FROM (SELECT r, 0 AS which, t FROM e UNION ALL SELECT r, 1, edited FROM e)),
l AS MATERIALIZED (SELECT r, which, greatest(0, least({LEVELS - 1}, length(bin(len(w))) - 2)) AS level, unnest(w) AS term FROM w WHERE len(w) > 0),
k AS (SELECT term, true AS known FROM l WHERE which = 0 GROUP BY term HAVING count(*) >= {LEAST_SHARE!r}::DOUBLE * (SELECT count(*) FROM d) AND count(*) <= {MOST_SHARE!r}::DOUBLE * (SELECT count(*) FROM d)),
s AS (SELECT r, which, level, term, sha256(term) AS sha, coalesce(known, false) AS known FROM l LEFT JOIN k USING (term)),
p AS (SELECT * FROM s WHERE len(list_filter(range({SUBSETS}), lambda n: {inside('level')})) > 0),
q AS (SELECT *, unnest(range({SUBSETS})) AS n FROM (SELECT *, bool_or(known) OVER (PARTITION BY r, which) AS any_known FROM p) WHERE known OR NOT any_known),
h AS (SELECT r, which, level, n, {hashed('level')} AS c, {hashed('level + 1')} AS f FROM q GROUP BY r, which, level, n),
f AS MATERIALIZED (SELECT r, which, {{'level': level, 'coarse': list(c ORDER BY n), 'fine': list(f ORDER BY n)}} AS f FROM h GROUP BY r, which, level),
o AS MATERIALIZED (SELECT e.*, a.f AS f0, b.f AS f1 FROM e LEFT JOIN (SELECT r, f FROM f WHERE which = 0) a USING (r) LEFT JOIN (SELECT r, f FROM f WHERE which = 1) b USING (r)),
z AS (SELECT o.*, x.f0 AS f2 FROM o JOIN o x ON x.r = o.r % o.total + 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {text('f0')} AS fingerprint, {text('f1')} AS edited_fingerprint, {like('f0', 'f1')} AS near_edited, {like('f0', 'f2')} AS near_next FROM z"""


ORACLE_SQL = _sql()
