"""Token counts (operator 1): a map-side two-tier lookup.

Tier one is a broadcast hash table of the token counts of frequent pre-tokens, of at most
FREQUENT entries. Tier two is a bounded cache in each Python worker; what neither holds is
encoded in batches. Texts' pre-tokens are never shuffled: only summaries of at most SUMMARY_ROWS rows,
however many splits there are, meet to choose the frequent ones. The choice affects speed alone, never a count.

Why pre-tokens may be counted apart: the model is a BPE without pieces in which a word marker
follows another character, so no merge crosses from a word into the marker of the next one, and
without pieces that hold a line feed, so none crosses a line end. `TokenCounter` checks all pieces of
the model it is given for both, and the normaliser on one text; otherwise it encodes whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import small_batches, table

#: Entries of the broadcast table.
FREQUENT = 65_536
#: Splits that are asked for their frequent pre-tokens, and rows that they tell in all.
SAMPLED, SUMMARY_ROWS = 1_000, 500_000
#: Entries of a worker's cache; it starts anew when full. Longer pre-tokens are not kept.
CACHED, CACHED_BYTES = 400_000, 64

_MARK = "▁".encode()
_PARTS = re.compile(rb"\n[^ \n]*| +[^ \n]*")


def pre_tokens(text: bytes) -> list[bytes]:
    """Pre-tokens of a text: words without their one leading marker, further spaces kept, and
    line feeds with the word part behind them."""
    text = text.replace(_MARK, b" ")
    parts = text.replace(b"\n", b" \n").split(b" ")
    if b"" in parts or parts[0][:1] == b"\n":
        return [p if p[:1] == b"\n" else p[1:] for p in _PARTS.findall(b" " + text)]
    return parts


class TokenCounter:
    """Counts the tokens of texts as sentencepiece does, without begin, end or other added tokens."""

    def __init__(self, model_path: str, frequent: dict[bytes, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = (
            not any(re.search("[^▁]▁|\n", p) for p in pieces)
            and self.model.encode("a\nb  c", out_type=str) == ["▁a", "<0x0A>", "b", "▁", "▁c"]
        )
        self.frequent, self.cache = frequent or {}, {}

    def lengths(self, parts: list[bytes]) -> list[int]:
        # A part that begins with a line feed has no marker of its own; an empty one is a lone marker.
        return [len(ids) - (p[:1] == b"\n") if p else 1 for p, ids in zip(parts, self.model.encode(parts, num_threads=1))]

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.separable:
            return [len(self.model.encode(t)) if t else 0 for t in texts]
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            found = list(map(self.frequent.get, parts := pre_tokens(text)))
            if None in found:
                misses = [p for p, n in zip(parts, found) if n is None]
                cache = self.cache
                if new := [p for p in set(misses) if p not in cache]:
                    if len(cache) + len(new) > CACHED:
                        cache.clear()
                        new = list(set(misses))
                    cache.update(zip(new, self.lengths(new)))
                total = sum(map(cache.__getitem__, misses)) + sum(n for n in found if n is not None)
                for p in new:
                    if len(p) > CACHED_BYTES:
                        del cache[p]
                out.append(total)
            else:
                out.append(sum(found))
        return out


def frequent_lengths(texts: DataFrame, model_path: str, size: int = FREQUENT) -> dict[bytes, int]:
    """Token counts of at most `size` frequent pre-tokens. At most SAMPLED splits, spread over all,
    tell the most frequent pre-tokens of their first Arrow batch, SUMMARY_ROWS in all; their sums choose.
    Only a warm start: what is missing here is encoded by the workers."""
    splits = max(1, texts.rdd.getNumPartitions())
    apart = -(-splits // SAMPLED)
    each = min(size, SUMMARY_ROWS // -(-splits // apart))

    def summary(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % apart:
            return
        for batch in batches:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(p for p in pre_tokens(text) if len(p) <= CACHED_BYTES)
            top = seen.most_common(each)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])
            return

    rows = texts.mapInArrow(summary, "part binary, n long").groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(size).collect()
    parts = [bytes(r["part"]) for r in rows]
    counter = TokenCounter(model_path)
    return dict(zip(parts, counter.lengths(parts))) if counter.separable and parts else {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Null ids, repeated rows and repeated ids are
    kept as they are; other columns are ignored, whatever their names. An empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows.select("text"), model_path))

    def count(batches):
        counter = TokenCounter(model_path, shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
