"""Benchmark decontamination (operator 8): a generalised suffix automaton of the test items.

Words of a document stream through the automaton of all normalised items; where the longest match
reaches a window's length, the words are hit. Items are taken in blocks of at most BLOCK_WORDS
words, one automaton a block, so what is broadcast is bounded; each further block reads what the
one before it wrote.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import ALNUM, LOWER, cut, packed, sliced, small_batches, table, unpacked

WINDOW = 10
BLOCK_WORDS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of items; items are (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        self.windows, short, shortest = defaultdict(set), defaultdict(set), {}
        for name, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
            for i in range(max(1, len(item) - window + 1) if item else 0):
                self.windows[tuple(item[i : i + window])].add(name)
            if 0 < len(item) < window:
                short[tuple(item)].add(name)
        for item in short:
            state = 0
            for word in item:
                state = self.next[state][word]
            shortest[state] = item
        # Short items that end wherever a state does: its own, and those of its suffixes.
        self.ends = {}
        if shortest:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                found = self.ends.get(self.link[state], ()) + ((shortest[state],) if state in shortest else ())
                if found:
                    self.ends[state] = found

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def match(self, doc: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit spans [start, end) in words, and the ids of items with occurring windows."""
        nxt, link, length, ends, window = self.next, self.link, self.length, self.ends, self.window
        spans, items, state, size = [], set(), 0, 0
        root = nxt[0]
        for i, word in enumerate(doc):
            if (to := nxt[state].get(word)) is not None:
                state, size = to, size + 1
            elif word not in root:
                state = size = 0
                continue
            else:
                while (to := nxt[state].get(word)) is None:
                    state = link[state]
                size, state = length[state] + 1, to
            if size >= window:
                items |= self.windows[tuple(doc[i - window + 1 : i + 1])]
                _cover(spans, i - window + 1, i + 1)
            if state in ends:
                for item in ends[state]:
                    if len(item) <= size:
                        items |= self.windows[item]
                        _cover(spans, i - len(item) + 1, i + 1)
        return spans, items


def _cover(spans: list[list[int]], start: int, end: int) -> None:
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append([start, end])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    block, total = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(text_col).isNotNull()).toLocalIterator():
        item = words(bytes(row[1]))
        if item:
            block.append((row[0], item))
            total += len(item)
        if total >= size:
            yield block
            block, total = [], 0
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, text_col: str, item_id: str, item_text: str, keep: list[str], max_coverage: float | None = None) -> DataFrame:
    """The columns `keep` as the struct `_own`, the text as `_text`, n_words, spans and items; with
    max_coverage, instead, `_own` and `_text` without the hit spans of the rows that stay."""
    small_batches(docs.sparkSession)
    new = [F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<struct<start:long,end:long>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items")]
    rows = docs.select(packed(keep), F.col(text_col).alias("_text"), *new)
    schema, short = rows.schema, rows.select("_own", "_text").schema

    def matched(batch, automaton):
        """(number of words, spans, ids) of each row, with what earlier blocks found."""
        for text, old, names in zip(*(batch.column(i) for i in (1, 3, 4))):
            doc = words((text.as_py() or "").encode())
            found, ids = automaton.match(doc) if doc else ([], set())
            merged = []
            for start, end in sorted([*found, *((s["start"], s["end"]) for s in old.as_py())]):
                _cover(merged, start, end)
            yield len(doc), merged, sorted(({*ids} - {None}) | {*names.as_py()})

    def matcher(shared):
        def match(batches):
            for batch in sliced(batches, 1):
                if batch.num_rows:
                    n, spans, items = zip(*matched(batch, shared.value))
                    spans = pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], _SPANS)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], schema.names)

        return match

    def remover(shared):
        def remove(batches):
            for batch in sliced(batches, 1):
                stays, texts, changed = [], batch.column(1), {}
                for i, (n, spans, _) in enumerate(matched(batch, shared.value)):
                    if sum(e - s for s, e in spans) <= n * max_coverage:
                        stays.append(i)
                        if spans:
                            changed[i] = _without(texts[i].as_py(), spans)
                if changed:
                    texts = pa.array([changed[i] if i in changed else t.as_py() for i, t in enumerate(texts)], texts.type)
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], short.names).take(pa.array(stays, pa.int64()))

        return remove

    context, blocks = docs.sparkSession.sparkContext, _blocks(benchmark, item_id, item_text, block_words)
    block = next(blocks, [])
    while True:
        shared, following = context.broadcast(Automaton(block, window)), next(blocks, None)
        if following is None:
            return rows.mapInArrow(matcher(shared), schema) if max_coverage is None else rows.mapInArrow(remover(shared), short)
        rows, block = cut(rows.mapInArrow(matcher(shared), schema)), following


def _without(text: str, spans) -> str:
    data = text.encode()
    places, parts, last = [m.span() for m in _WORD.finditer(data.translate(LOWER))], [], 0
    for start, end in spans:
        parts.append(data[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*parts, data[last:]]).decode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), n_words, spans (merged hit spans in words) and items
    (ids as strings).

    An item of fewer than `window` words, but not none, is one window. Null texts and null items
    have no words; items of a null id hit but are not listed. Rows, repeated ones too, stay. A new column
    whose name `keep` has already gets an underscore behind it. Empty tables give no rows or no hits.
    """
    columns = docs.columns if keep is None else keep
    return unpacked(_found(docs, benchmark, window, block_words, text_col, item_id, item_text, columns), columns, ["n_words", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.8, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the words of hit spans (and what stands between them); a document of which hit
    words make up more than max_coverage goes. Documents without hits stay byte for byte. Other columns
    stay, whatever their names; nulls as find_contamination."""
    others = [c for c in docs.columns if c != text_col]
    out = _found(docs, benchmark, window, block_words, text_col, item_id, item_text, others, max_coverage)
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col("_own")[c].alias(c) for c in docs.columns))


def op8_decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS a FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, size, array_to_string(w[a : a + size - 1], ' ') AS win FROM p),
q AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size),
g AS (SELECT doc_id, a, size, array_to_string(w[a : a + size - 1], ' ') AS win FROM q),
h AS (SELECT doc_id, a, size, item_id FROM g JOIN v USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + size)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
