"""Registered queries of the search engine and their SQL.

Texts are all part names, documents, conversations; patterns are all different part names, their words,
whole benchmark items and their long words, region and nation names: whole tables, nothing cut.
"""

import uuid

from pyspark.sql import functions as F

from motifspark.operators import hamming, index, prepare, shaping, store
from motifspark.operators.corpus_index import CorpusIndex
from motifspark.operators.search import kmismatch, multi_pattern_scan
from motifspark.operators.tables import shared_dir
from motifspark.sources.split_files import kmismatch_files
from motifspark.streaming.chunks import chunked_search, stream_events

#: Mismatches of the searches, block of the blocked ones, and the longest part name that it allows.
K, SMALL_BLOCK = 2, 64
#: Starts of a range of the search in ranges; most documents are longer.
SMALL_RANGE = 500
#: Bytes of a file that a task reads in the search in files.
SMALL_SPLIT = 2 << 20
#: Long words have at least this many characters.
LONG_WORD = 10

QUERIES, ORACLE_SQL = {}, {}


def query(sql):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))


def _names(spark, sf_dir):
    """Each different part name once, under its smallest key."""
    return prepare.accepted_patterns(_parts(spark, sf_dir).toDF("pattern_id", "pattern"))


def _words(spark, sf_dir):
    """The words of part names, each named by itself."""
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("pattern")).where("pattern <> ''").distinct()
    return words.select(F.col("pattern").alias("pattern_id"), "pattern")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def _items(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))


def _long_words(spark, sf_dir):
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("pattern")).where(F.length("pattern") >= LONG_WORD).distinct()
    return words.select(F.col("pattern").alias("pattern_id"), "pattern")


# Linear and circular search.

_X = "x AS (SELECT min(p_partkey) AS pattern_id, p_name AS x FROM part WHERE length(p_name) > 0 GROUP BY p_name), t AS (SELECT DISTINCT p_name AS t FROM part)"
_STARTS = f"{_X}, w AS (SELECT t, pattern_id, x, unnest(range(0, length(t) - length(x) + 1)) AS pos FROM t, x WHERE length(t) >= length(x))"
_DIFFER = "len(list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) <> substr({w}, {at}i, 1)))"
_LINEAR = f"""
WITH {_STARTS}, d AS (SELECT t, pattern_id, pos, {_DIFFER.format(x="x", w="t", at="pos + ")} AS distance FROM w)
SELECT p_partkey AS text_id, pattern_id, CAST(pos AS BIGINT) AS pos, CAST(distance AS INTEGER) AS distance FROM d JOIN part ON p_name = t WHERE distance <= {K}"""
_CIRCULAR = f"""
WITH {_STARTS}, r AS (SELECT *, unnest(range(0, length(x))) AS rotation FROM w),
y AS (SELECT t, pattern_id, pos, rotation, substr(x || x, rotation + 1, length(x)) AS y FROM r),
d AS (SELECT t, pattern_id, pos, rotation, {_DIFFER.format(x="y", w="t", at="pos + ")} AS distance FROM y),
n AS (SELECT *, row_number() OVER (PARTITION BY t, pattern_id, pos ORDER BY distance, rotation) AS turn FROM d)
SELECT p_partkey AS text_id, pattern_id, CAST(pos AS BIGINT) AS pos, CAST(distance AS INTEGER) AS distance, CAST(rotation AS INTEGER) AS rotation
FROM n JOIN part ON p_name = t WHERE turn = 1 AND distance <= {K}"""


@query(_LINEAR)
def linear_seed(spark, sf_dir):
    """Every part name in all part names, two mismatches."""
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K)


@query(_LINEAR)
def linear_scan(spark, sf_dir):
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, strategy="scan")


@query(_LINEAR)
def linear_joined(spark, sf_dir):
    """As linear_seed, with the patterns' seeds as a partitioned relation that the texts' seeds join."""
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, strategy="join")


@query(_LINEAR)
def linear_blocked(spark, sf_dir):
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, block_size=SMALL_BLOCK)


@query(_CIRCULAR)
def circular_seed(spark, sf_dir):
    """Every rotation of every part name in all part names, two mismatches."""
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, circular=True)


@query(_CIRCULAR)
def circular_scan(spark, sf_dir):
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, circular=True, strategy="scan")


@query(_CIRCULAR)
def circular_joined(spark, sf_dir):
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, circular=True, strategy="join")


@query(_CIRCULAR)
def circular_blocked(spark, sf_dir):
    return kmismatch(_parts(spark, sf_dir), _names(spark, sf_dir), K, circular=True, block_size=SMALL_BLOCK)


def _in_documents(patterns: str, k: int, circular: bool, gram: int) -> str:
    """SQL of a search in all documents: candidates by the first `gram` characters of each piece."""
    doubled, step, last = ("x || substr(x, 1, length(x) - 1)", f"(length(x) + 1) // {k + 2}", "2 * length(x) - 1 - step") if circular else ("x", f"length(x) // {k + 1}", f"{k} * step")
    rotations = "unnest(range(greatest(0, off + step - m), least(off, m - 1) + 1))" if circular else "0"
    return f"""
WITH x AS ({patterns}), p AS (SELECT pattern_id, {doubled} AS xx, length(x) AS m, {step} AS step, {last.replace('step', f'({step})')} AS last FROM x),
o AS (SELECT *, unnest(range(0, last + 1, step)) AS off FROM p), s AS (SELECT pattern_id, m, step, off, substr(xx, off + 1, {gram}) AS g FROM o),
l AS (SELECT doc_id, text, unnest(range(0, length(text), 256)) AS low FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, low, substr(text, low + 1, {256 + gram}) AS b FROM l),
q AS (SELECT doc_id, low + i AS q, substr(b, i + 1, {gram}) AS g FROM (SELECT doc_id, low, b, unnest(range(0, least(256, length(b)))) AS i FROM b)),
h AS (SELECT doc_id, pattern_id, m, q - off AS diagonal, {rotations} AS rotation FROM q JOIN s USING (g)),
c AS (SELECT DISTINCT doc_id, pattern_id, m, diagonal + rotation AS pos, rotation FROM h WHERE diagonal + rotation >= 0),
v AS (SELECT c.*, substr(xx, rotation + 1, c.m) AS y, substr(text, pos + 1, c.m) AS w FROM c JOIN p USING (pattern_id) JOIN documents USING (doc_id)),
d AS (SELECT doc_id, pattern_id, pos, rotation, {_DIFFER.format(x="y", w="w", at="")} AS distance FROM v WHERE length(w) = m),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_id, pos ORDER BY distance, rotation) AS turn FROM d WHERE distance <= {k})
SELECT doc_id AS text_id, pattern_id, CAST(pos AS BIGINT) AS pos, CAST(distance AS INTEGER) AS distance{', CAST(rotation AS INTEGER) AS rotation' if circular else ''} FROM n WHERE turn = 1"""


_ITEMS = "SELECT item_id AS pattern_id, text AS x FROM benchmark WHERE length(text) > 0"
_LONG = f"SELECT x AS pattern_id, x FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS x FROM benchmark) WHERE length(x) >= {LONG_WORD}"


@query(_in_documents(_ITEMS, K, False, 8))
def document_search(spark, sf_dir):
    """Every whole benchmark item in all documents, two mismatches."""
    return kmismatch(_documents(spark, sf_dir), _items(spark, sf_dir), K)


@query(_in_documents(_ITEMS, K, True, 8))
def document_search_circular(spark, sf_dir):
    """Every rotation of every whole benchmark item in all documents, two mismatches."""
    return kmismatch(_documents(spark, sf_dir), _items(spark, sf_dir), K, circular=True)


@query(_in_documents(_ITEMS, K, False, 8))
def document_search_ranges(spark, sf_dir):
    """As document_search; texts longer than a range are cut into overlapping ones, which are spread."""
    return kmismatch(_documents(spark, sf_dir), _items(spark, sf_dir), K, range_size=SMALL_RANGE)


@query(_in_documents(_ITEMS, K, True, 8))
def document_search_joined(spark, sf_dir):
    """As document_search_circular, by a join of seeds."""
    return kmismatch(_documents(spark, sf_dir), _items(spark, sf_dir), K, circular=True, strategy="join")


@query(f"SELECT text_id, pattern_id, pos, distance FROM ({_in_documents(_ITEMS, K, False, 8)}) WHERE distance <= pattern_id % {K + 1}")
def document_search_thresholds(spark, sf_dir):
    """Every whole benchmark item in all documents, each with a number of mismatches of its own."""
    items = _items(spark, sf_dir).withColumn("k", F.col("pattern_id") % (K + 1))
    return kmismatch(_documents(spark, sf_dir), items, None)


@query(f"""SELECT text_id, pattern_id, CAST(strlen(substr(text, 1, pos)) AS BIGINT) AS pos, CAST(strlen(substr(text, 1, pos)) + strlen(pattern_id) AS BIGINT) AS end_pos
FROM ({_in_documents(_LONG, 0, False, LONG_WORD)}) JOIN documents ON doc_id = text_id""")
def byte_scan(spark, sf_dir):
    """The long words of the benchmark in all documents, both as bytes in UTF-8; places count bytes."""
    texts, patterns = _documents(spark, sf_dir), _long_words(spark, sf_dir)
    return multi_pattern_scan(texts.withColumn("text", F.col("text").cast("binary")), patterns.withColumn("pattern", F.col("pattern").cast("binary")))


@query(f"SELECT pattern_id, count(*) AS n FROM ({_in_documents(_LONG, 0, False, LONG_WORD)}) GROUP BY pattern_id")
def file_search(spark, sf_dir):
    """How often the long words of the benchmark stand in all documents, which are written as text files;
    tasks read these in ranges of bytes."""
    path = f"{shared_dir(spark)}/texts/{uuid.uuid4().hex}"
    _documents(spark, sf_dir).select(F.coalesce("text", F.lit(""))).write.text(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    found = kmismatch_files(spark, path, _long_words(spark, sf_dir), 0, split_bytes=SMALL_SPLIT, row_bytes=SMALL_SPLIT // 8)
    return found.groupBy("pattern_id").agg(F.count("*").alias("n"))


_SYMBOLS = "string_split(text, ' ')"


@query(f"""
WITH x AS (SELECT item_id, {_SYMBOLS} AS x FROM benchmark), p AS (SELECT item_id, x, len(x) AS m, unnest(range(0, {K + 1})) * (len(x) // {K + 1}) AS off FROM x),
w AS (SELECT doc_id, {_SYMBOLS} AS w FROM documents), q AS (SELECT doc_id, unnest(w) AS s, unnest(range(0, len(w))) AS place FROM w),
c AS (SELECT DISTINCT doc_id, item_id, place - off AS pos FROM q JOIN p ON s = x[off + 1] WHERE place >= off),
d AS (SELECT doc_id, item_id, pos, len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> w[pos + i])) AS distance FROM c JOIN x USING (item_id) JOIN w USING (doc_id) WHERE pos + len(x) <= len(w))
SELECT doc_id AS text_id, item_id AS pattern_id, CAST(pos AS BIGINT) AS pos, CAST(distance AS INTEGER) AS distance FROM d WHERE distance <= {K}""")
def symbol_search(spark, sf_dir):
    """Every benchmark item in all documents, words being the symbols, two mismatches."""
    split = lambda column: F.split(column, " ")
    return kmismatch(_documents(spark, sf_dir).withColumn("text", split("text")), _items(spark, sf_dir).withColumn("pattern", split("pattern")), K)


@query(_in_documents(_LONG, 1, False, LONG_WORD // 2))
def document_words(spark, sf_dir):
    """The long words of the benchmark in all documents, one mismatch."""
    return kmismatch(_documents(spark, sf_dir), _long_words(spark, sf_dir), 1)


# Exact scans.

_SCAN = """
SELECT p_partkey AS text_id, x AS pattern_id, CAST(pos AS BIGINT) AS pos, CAST(pos + length(x) AS BIGINT) AS end_pos
FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS pos FROM part), (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS x FROM part)
WHERE x <> '' AND substr(p_name, pos + 1, length(x)) = x"""


@query(_SCAN)
def exact_scan(spark, sf_dir):
    """The words of part names in all part names."""
    return multi_pattern_scan(_parts(spark, sf_dir), _words(spark, sf_dir))


def _event_patterns(spark, sf_dir):
    """The words and all that they end with, so that patterns end together."""
    words = _words(spark, sf_dir).select("pattern", F.explode(F.expr("sequence(1, length(pattern))")).alias("at"))
    return words.select(F.expr("substring(pattern, at)").alias("pattern")).distinct().select(F.col("pattern").alias("pattern_id"), "pattern")


_ENDINGS = "SELECT DISTINCT substr(w, a) AS x FROM (SELECT w, unnest(range(1, length(w) + 1)) AS a FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part))"
_EVENTS = f"""SELECT p_partkey AS text_id, x AS pattern_id, CAST(pos + length(x) AS BIGINT) AS end_pos
FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS pos FROM part), ({_ENDINGS}) WHERE substr(p_name, pos + 1, length(x)) = x"""


@query(f"SELECT text_id, end_pos, string_agg(pattern_id, ',' ORDER BY pattern_id) AS patterns, count(*) AS match_num FROM ({_EVENTS}) GROUP BY text_id, end_pos")
def multi_pattern_events(spark, sf_dir):
    """All endings of the words of part names that end at each place of all part names."""
    found = shaping.match_events(multi_pattern_scan(_parts(spark, sf_dir), _event_patterns(spark, sf_dir)))
    return found.withColumn("patterns", F.array_join("patterns", ","))


@query(f"SELECT text_id, end_pos, min(pattern_id) AS pattern_id FROM ({_EVENTS}) e WHERE end_pos = (SELECT min(end_pos) FROM ({_EVENTS}) f WHERE f.text_id = e.text_id) GROUP BY text_id, end_pos")
def first_match_early_stop(spark, sf_dir):
    """The first place of each part name at which a pattern ends; names are read no further."""
    return shaping.first_event(multi_pattern_scan(_parts(spark, sf_dir), _event_patterns(spark, sf_dir), stop_after=1))


@query("SELECT p_partkey AS pattern_id, CASE WHEN length(coalesce(p_name, '')) = 0 THEN 'empty' WHEN length(p_name) > 10 THEN 'long' WHEN p_partkey > min(p_partkey) OVER (PARTITION BY p_name) THEN 'duplicate' ELSE 'ok' END AS status FROM part")
def multi_pattern_status(spark, sf_dir):
    return prepare.pattern_status(_parts(spark, sf_dir).toDF("pattern_id", "pattern"), 10)


@query("SELECT min(p_partkey) AS pattern_id, p_name AS pattern FROM part WHERE length(p_name) > 0 GROUP BY p_name")
def accepted_patterns(spark, sf_dir):
    return _names(spark, sf_dir)


@query("""SELECT substr(x, 1, d - 1) AS parent, substr(x, d, 1) AS symbol, substr(x, 1, d) AS child, count(*) AS patterns, count(*) FILTER (d = length(x)) AS ends
FROM (SELECT p_name AS x, unnest(range(1, length(p_name) + 1)) AS d FROM part) GROUP BY ALL""")
def trie_edges(spark, sf_dir):
    return prepare.trie_edges(_parts(spark, sf_dir).toDF("pattern_id", "pattern"))


# Chunked search.

def _in_conversations(era: str) -> str:
    """SQL of the search for long words in conversations that begin anew where `era` counts one more."""
    return f"""
WITH e AS (SELECT conv_id, turn, text, {era} AS era FROM conversations), t AS (SELECT conv_id, era, string_agg(text, '' ORDER BY turn) AS t FROM e GROUP BY conv_id, era), x AS ({_LONG}),
h AS (SELECT conv_id, era, t, x FROM t, x WHERE contains(t, substr(x, 1, length(x) // 2)) OR contains(t, substr(x, length(x) // 2 + 1, length(x) // 2))),
w AS (SELECT conv_id, era, x, pos, substr(t, pos + 1, length(x)) AS w FROM (SELECT *, unnest(range(0, length(t) - length(x) + 1)) AS pos FROM h WHERE length(t) >= length(x))),
d AS (SELECT conv_id, era, x, pos, {_DIFFER.format(x="x", w="w", at="")} AS distance FROM w WHERE substr(w, 1, length(x) // 2) = substr(x, 1, length(x) // 2) OR substr(w, length(x) // 2 + 1, length(x) // 2) = substr(x, length(x) // 2 + 1, length(x) // 2))
SELECT conv_id AS stream, CAST(era AS BIGINT) AS era, x AS pattern_id, CAST(pos AS BIGINT) AS pos, CAST(distance AS INTEGER) AS distance FROM d WHERE distance <= 1"""


_RESETS = "sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)"


def _turns(rows, reset):
    return rows.select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), "text", reset.alias("reset"))


@query(_in_conversations("0"))
def conversation_search(spark, sf_dir):
    """The long words of the benchmark in whole conversations, whose turns are chunks; one mismatch."""
    return chunked_search(_turns(_table(spark, sf_dir, "conversations"), F.lit(False)), _long_words(spark, sf_dir), 1)


@query(_in_conversations(_RESETS))
def conversation_resets(spark, sf_dir):
    """As conversation_search; each turn of a user resets the text, so matches reach into answers only."""
    return chunked_search(_turns(_table(spark, sf_dir, "conversations"), F.col("role") == "user"), _long_words(spark, sf_dir), 1)


@query(_in_conversations(_RESETS))
def conversation_stream(spark, sf_dir):
    """As conversation_resets, over the turns as a stream that keeps each conversation's state."""
    words = [r[0] for r in _long_words(spark, sf_dir).select("pattern").collect()]
    batch = _table(spark, sf_dir, "conversations")
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    # The turns are written once in the shared folder, as a stream reads folders only.
    batch.write.parquet(f"{folder}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        turns = _turns(spark.readStream.schema(batch.schema).parquet(f"{folder}/in"), F.col("role") == "user")
        events = stream_events(turns, list(enumerate(words)), 1)
        running = events.writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(store, before) if before is not None else spark.conf.unset(store)
    found = spark.read.schema(events.schema).parquet(f"{folder}/out").where("kind = 'match'")
    names = F.array(*map(F.lit, words)) if words else F.array(F.lit(""))
    return found.select(F.col("stream").cast("long").alias("stream"), "era", F.element_at(names, (F.col("pattern_id") + 1).cast("int")).alias("pattern_id"), "pos", "distance")


# Preparation.

_CUT = "SELECT pattern_id, f, f * (m // 3) + least(f, m % 3) AS off, substr(x, f * (m // 3) + least(f, m % 3) + 1, m // 3 + CASE WHEN f < m % 3 THEN 1 ELSE 0 END) AS fragment FROM (SELECT p_partkey AS pattern_id, p_name AS x, length(p_name) AS m, unnest(range(0, 3)) AS f FROM part WHERE length(p_name) > 0)"


def _fragments(spark, sf_dir):
    return prepare.fragments(_parts(spark, sf_dir).toDF("pattern_id", "pattern"), 3)


def _letters(spark, sf_dir):
    """Part names in as many fragments as the shortest has characters, of which some are equal."""
    names = _parts(spark, sf_dir).toDF("pattern_id", "pattern")
    return prepare.fragments(names, 7)


_SEVENTHS = _CUT.replace("range(0, 3)", "range(0, 7)").replace("m // 3", "m // 7").replace("m % 3", "m % 7")


@query(f"SELECT pattern_id, CAST(f AS INTEGER) AS frag_id, CAST(off AS INTEGER) AS off, fragment FROM ({_CUT})")
def pattern_fragments(spark, sf_dir):
    return _fragments(spark, sf_dir)


@query(f"SELECT pattern_id, CAST(f AS INTEGER) AS frag_id, CAST(min(f) OVER (PARTITION BY pattern_id, fragment) AS INTEGER) AS first_equal FROM ({_SEVENTHS})")
def fragment_duplicates(spark, sf_dir):
    return prepare.equal_fragments(_letters(spark, sf_dir))


@query(f"SELECT pattern_id, count(*) AS fragments, count(DISTINCT fragment) AS distinct_fragments FROM ({_SEVENTHS}) GROUP BY pattern_id")
def fragment_counts(spark, sf_dir):
    return prepare.fragment_counts(_letters(spark, sf_dir))


@query(f"SELECT fragment, count(*) AS members, string_agg(pattern_id || ':' || f || ':' || off, ',' ORDER BY pattern_id, f, off) AS places FROM ({_CUT}) WHERE fragment <> '' GROUP BY fragment")
def fragment_groups(spark, sf_dir):
    groups = prepare.fragment_groups(_fragments(spark, sf_dir))
    return groups.withColumn("places", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p.pattern_id, p.frag_id, p.off)), ","))


@query("SELECT CAST(r_regionkey AS BIGINT) AS pattern_id, CAST(r AS INTEGER) AS rotation, substr(x || x, r + 1, length(x)) AS rotated FROM (SELECT r_regionkey, r_name AS x, unnest(range(0, length(r_name))) AS r FROM region)")
def pattern_rotations(spark, sf_dir):
    return prepare.rotations(_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("pattern_id"), F.col("r_name").alias("pattern")))


@query("SELECT item_id AS pattern_id, text || substr(text, 1, length(text) - 1) AS doubled FROM benchmark WHERE length(text) > 0")
def doubled_pattern(spark, sf_dir):
    return prepare.doubled_patterns(_items(spark, sf_dir))


@query("SELECT doc_id AS text_id, array_to_string(list_reverse(string_split(text, '')), '') AS reversed FROM documents")
def reversed_text(spark, sf_dir):
    return prepare.reversed_texts(_documents(spark, sf_dir))


@query("""SELECT doc_id AS text_id, CAST(s AS INTEGER) AS start, CAST(greatest(0, s - 100) AS INTEGER) AS low, substr(text, greatest(0, s - 100) + 1, s - greatest(0, s - 100) + 4196) AS block, CAST(length(text) AS INTEGER) AS text_length
FROM (SELECT doc_id, text, unnest(range(0, length(text), 4096)) AS s FROM documents)""")
def text_blocks(spark, sf_dir):
    return prepare.blocks(_documents(spark, sf_dir), 4096, 100)


# Index structures.

_AGREE = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i)))"
_SUFFIXES = f"""
SELECT text_id, pos, rank, CASE WHEN before IS NULL THEN 0 ELSE {_AGREE.format(a="suffix", b="before")} END AS lcp FROM (
  SELECT p_partkey AS text_id, pos, suffix, row_number() OVER w - 1 AS rank, lag(suffix) OVER w AS before
  FROM (SELECT p_partkey, pos, substr(p_name, pos + 1) AS suffix FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS pos FROM part))
  WINDOW w AS (PARTITION BY p_partkey ORDER BY suffix))"""


@query(f"""SELECT text_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN pos = 0 THEN 0 ELSE {_AGREE.format(a="t", b="substr(t, pos + 1)")} END AS INTEGER) AS z
FROM (SELECT p_partkey AS text_id, p_name AS t, unnest(range(0, length(p_name))) AS pos FROM part)""")
def prefix_array(spark, sf_dir):
    return index.prefix_array(_parts(spark, sf_dir))


@query(f"SELECT text_id, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank, CAST(lcp AS INTEGER) AS lcp FROM ({_SUFFIXES})")
def suffix_array(spark, sf_dir):
    return index.suffix_array(_parts(spark, sf_dir))


@query(f"SELECT text_id, string_agg(rank, ',' ORDER BY pos) AS ranks FROM ({_SUFFIXES}) GROUP BY text_id")
def inverse_suffix_array(spark, sf_dir):
    rows = index.suffix_array(_parts(spark, sf_dir)).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("r"))
    return rows.select("text_id", F.array_join(F.col("r.rank").cast("array<string>"), ",").alias("ranks"))


@query(f"SELECT text_id, CAST(rank AS INTEGER) AS rank, CAST(lcp AS INTEGER) AS lcp FROM ({_SUFFIXES})")
def lcp_array(spark, sf_dir):
    return index.lcp_array(index.suffix_array(_parts(spark, sf_dir)))


_CORPUS = """SELECT rank, text_id, pos, CASE WHEN before IS NULL THEN 0 ELSE {agree} END AS lcp FROM (
  SELECT p_partkey AS text_id, pos, suffix, row_number() OVER w - 1 AS rank, lag(suffix) OVER w AS before
  FROM (SELECT p_partkey, pos, substr(p_name, pos + 1) AS suffix FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS pos FROM part))
  WINDOW w AS (ORDER BY suffix, p_partkey, pos))""".format(agree=_AGREE.format(a="suffix", b="before"))


@query(f"SELECT rank, text_id, CAST(pos AS INTEGER) AS pos, CAST(lcp AS INTEGER) AS lcp FROM ({_CORPUS})")
def corpus_suffix_array(spark, sf_dir):
    """All suffixes of all part names in one order, and how far each agrees with the one before it."""
    return CorpusIndex(_parts(spark, sf_dir)).lcp_array()


def _longest(texts):
    return texts.agg(F.coalesce(F.max(F.length("text")), F.lit(1))).first()[0]


@query(f"""WITH s AS ({_SUFFIXES}), r AS (SELECT a.text_id, a.rank AS low, b.rank AS high FROM s a JOIN s b ON a.text_id = b.text_id AND a.rank <= b.rank)
SELECT r.text_id, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, CAST(min(lcp) AS INTEGER) AS least FROM r JOIN s ON r.text_id = s.text_id AND s.rank BETWEEN low AND high GROUP BY ALL""")
def rmq_min(spark, sf_dir):
    """The least lcp of every range of ranks of every part name."""
    parts = _parts(spark, sf_dir)
    ranges = parts.select("text_id", F.expr("length(text) AS n"), F.expr("explode(sequence(0, length(text) - 1)) AS low")).select("text_id", "low", F.expr("explode(sequence(low, n - 1)) AS high"))
    return index.range_minimum(index.lcp_array(index.suffix_array(parts)), ranges, _longest(parts))


@query(f"""SELECT text_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST({_AGREE.format(a="substr(t, i + 1)", b="substr(t, j + 1)").replace("lambda i", "lambda q").replace("1, i)", "1, q)")} AS INTEGER) AS lce
FROM (SELECT text_id, t, i, unnest(range(i, length(t))) AS j FROM (SELECT p_partkey AS text_id, p_name AS t, unnest(range(0, length(p_name))) AS i FROM part))""")
def lce_pairs(spark, sf_dir):
    """How far the suffixes at every two places of every part name agree."""
    parts = _parts(spark, sf_dir)
    pairs = parts.select("text_id", F.expr("length(text) AS n"), F.expr("explode(sequence(0, length(text) - 1)) AS i")).select("text_id", "i", F.expr("explode(sequence(i, n - 1)) AS j"))
    return index.common_extension(index.suffix_array(parts), pairs, _longest(parts))


# Mismatches.

_EQUAL = f"WITH {_X} SELECT a.pattern_id AS a, b.pattern_id AS b, a.x AS x, b.x AS w FROM x a JOIN x b ON length(a.x) = length(b.x)"


def _equal_names(spark, sf_dir):
    names = _names(spark, sf_dir)
    a = names.select(F.col("pattern_id").alias("a"), F.col("pattern").alias("x"))
    b = names.select(F.col("pattern_id").alias("b"), F.col("pattern").alias("w"))
    return a.join(b, F.length("x") == F.length("w"))


def _listed(rows, column):
    return rows.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


_PLACES = "list_filter(range(0, length(x)), lambda i: substr(x, i + 1, 1) <> substr(w, i + 1, 1))"


@query(f"SELECT a, b, array_to_string({_PLACES}, ',') AS places, CAST(len({_PLACES}) AS INTEGER) AS distance FROM ({_EQUAL})")
def mismatch_positions(spark, sf_dir):
    rows = _equal_names(spark, sf_dir).select("a", "b", hamming.mismatch_positions("x", "w").alias("places"), hamming.hamming("x", "w").alias("distance"))
    return _listed(rows, "places")


@query(f"SELECT a, b, array_to_string(list_transform(range(1, 4), lambda q: coalesce(p[q], length(x))), ',') AS extension FROM (SELECT a, b, x, {_PLACES} AS p FROM ({_EQUAL}))")
def k_extension(spark, sf_dir):
    return _listed(hamming.k_extension(_equal_names(spark, sf_dir), K), "extension").select("a", "b", "extension")


_SLIDE = _DIFFER.format(x="y", w="z", at="")


@query(f"""WITH e AS ({_EQUAL}), r AS (SELECT a, b, r, substr(x || x, r + 1, length(x)) AS y, substr(w || w, r + 1, length(x)) AS z FROM (SELECT *, unnest(range(0, length(x))) AS r FROM e))
SELECT a, b, string_agg({_SLIDE}, ',' ORDER BY r) AS distances FROM r GROUP BY a, b""")
def sliding_mismatch_sum(spark, sf_dir):
    """The distances of all rotations of part names to the stretches of other doubled ones."""
    rows = _equal_names(spark, sf_dir).withColumn("w", F.expr(prepare.doubled("w")))
    return _listed(hamming.sliding_mismatches(rows), "distances").select("a", "b", "distances")


# Shaping of results.

@query(f"SELECT pattern_id, distance, count(*) AS matches FROM ({_LINEAR}) GROUP BY pattern_id, distance")
def match_count(spark, sf_dir):
    return linear_seed(spark, sf_dir).groupBy("pattern_id", "distance").agg(F.count("*").alias("matches"))


@query(_LINEAR)
def matches_ordered(spark, sf_dir):
    return shaping.ordered(linear_seed(spark, sf_dir))


@query(f"SELECT text_id, pattern_id, string_agg(pos, ',' ORDER BY pos) AS positions, count(*) AS occurrences FROM ({_in_documents(_LONG, 1, False, LONG_WORD // 2)}) GROUP BY text_id, pattern_id")
def position_lists(spark, sf_dir):
    """Where the long words of the benchmark stand in each document, one mismatch."""
    return _listed(shaping.position_lists(document_words(spark, sf_dir)), "positions")


@query(f"SELECT *, 'linear' AS query FROM ({_LINEAR}) UNION ALL SELECT text_id, pattern_id, pos, distance, 'circular' FROM ({_CIRCULAR})")
def matches_appended(spark, sf_dir):
    return shaping.appended(("linear", linear_seed(spark, sf_dir)), ("circular", circular_seed(spark, sf_dir).drop("rotation")))


@query(f"SELECT text_id, pattern_id, pos, distance, CAST(turn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY distance, text_id, pos) AS turn FROM ({_CIRCULAR})) WHERE turn <= 3")
def best_match_topk(spark, sf_dir):
    return shaping.best_matches(circular_seed(spark, sf_dir).drop("rotation"), 3)


@query(f"SELECT doc_id AS text_id, text FROM documents WHERE doc_id IN (SELECT text_id FROM ({_in_documents(_ITEMS, K, False, 8)}))")
def docs_with_match(spark, sf_dir):
    """Documents are read until their first match."""
    docs = _documents(spark, sf_dir)
    return shaping.texts_with_match(docs, kmismatch(docs, _items(spark, sf_dir), K, stop_after=1))


@query(f"SELECT doc_id AS text_id, text FROM documents WHERE doc_id NOT IN (SELECT text_id FROM ({_in_documents(_ITEMS, K, False, 8)}))")
def docs_without_match(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return shaping.texts_without_match(docs, kmismatch(docs, _items(spark, sf_dir), K, stop_after=1))


# Keyed pattern store.

def _store(spark, sf_dir):
    """Part names and their smallest keys."""
    return _names(spark, sf_dir).select(F.col("pattern").alias("key"), F.col("pattern_id").alias("value"))


def _new(spark, sf_dir):
    """The words of part names and the names of parts of brand 1, under negative values."""
    names = _table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select(F.col("p_name").alias("key"))
    words = _words(spark, sf_dir).select(F.col("pattern").alias("key"))
    return names.distinct().unionByName(words).withColumn("value", -F.length("key").cast("long"))


_STORE = "SELECT p_name AS key, min(p_partkey) AS value FROM part WHERE length(p_name) > 0 GROUP BY p_name"
_NEW = "SELECT key, CAST(-length(key) AS BIGINT) AS value FROM (SELECT DISTINCT p_name AS key FROM part WHERE p_brand = 'Brand#1' UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part) WHERE key <> ''"


@query(f"SELECT n.key, s.value FROM ({_NEW}) n LEFT JOIN ({_STORE}) s ON s.key = n.key")
def store_retrieve(spark, sf_dir):
    return store.retrieve(_store(spark, sf_dir), _new(spark, sf_dir).select("key"))


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_STORE}) s WHERE key NOT IN (SELECT key FROM ({_NEW}))")
def store_upsert(spark, sf_dir):
    return store.store_all(_store(spark, sf_dir), _new(spark, sf_dir))


@query(f"SELECT * FROM ({_STORE}) UNION ALL SELECT * FROM ({_NEW}) n WHERE key NOT IN (SELECT key FROM ({_STORE}))")
def store_if_absent(spark, sf_dir):
    return store.store_if_absent(_store(spark, sf_dir), _new(spark, sf_dir))


@query(f"SELECT * FROM ({_STORE}) s WHERE key NOT IN (SELECT key FROM ({_NEW}))")
def store_delete(spark, sf_dir):
    return store.delete(_store(spark, sf_dir), _new(spark, sf_dir).select("key"))


@query(f"{_STORE} ORDER BY key")
def store_enumerate(spark, sf_dir):
    return store.enumerate_keys(_store(spark, sf_dir))


@query(f"SELECT substr(key, 2, 1) AS symbol, count(*) AS keys, bool_or(length(key) = 2) AS terminal FROM ({_STORE}) WHERE key LIKE 's_%' GROUP BY 1")
def store_walk(spark, sf_dir):
    return store.walk(_store(spark, sf_dir), "s")


def flagship(spark, sf_dir):
    return document_words(spark, sf_dir)
