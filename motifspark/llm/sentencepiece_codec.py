"""SentencePiece encoding and decoding (operator 3) on the tokenizers library.

The model's protobuf is parsed here; normaliser, word marker, scores and byte fallback are rebuilt
as a tokenizers pipeline: a unigram model from its scores, or a BPE whose merges are ranked by the
scores of what they make. Batches are encoded by a bounded number of the library's threads.

Parity with the sentencepiece library is verified wherever ids are made. Under a BPE in which no
merge crosses into the next word's marker or a line end (`Codec.separable`), a text's ids are those of
its words, one after the other: distinct words are encoded, compared with sentencepiece once, and
kept in a bounded cache; a difference raises. All other models encode, and compare, whole texts; unigram
models sum scores in other precisions, so paths of nearly equal scores may differ, and then
sentencepiece's ids stand.

Texts become Python objects in slices of a few megabytes, so a worker's memory is bounded by the
longest text, not by the batch.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import sliced, table

#: Threads of the library in each Python worker.
THREADS = 2
#: Words whose ids a worker keeps; the cache starts anew when full. Longer words are not kept.
CACHED, CACHED_CHARS = 400_000, 64
#: Words that one of the library's threads encodes at once, and how many such parts are held at once.
CHUNK, AT_ONCE = 2000, 8
MARK = "▁"
#: Fixed values of the model format: kinds of pieces, kinds of models.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, float or bytes."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif key & 7 == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {key & 7}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: 1} | dict(fields(value))
            model.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_blanks, model.escape_blanks = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return model


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not model.escape_blanks or any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with plain blanks or user-defined pieces are not supported")
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: s for p, s, kind in model.pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
        merges = [(-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, score in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        core = models.BPE(ids, [m[3:] for m in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
        # No piece crosses into the next word: words may be encoded, and cached, apart.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+$"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    out.encode_special_tokens = True
    return out


_PARTS = re.compile("\n[^ \n]*| +[^ \n]*")


def words_of(text: str) -> list[str]:
    """Words of a text without their one leading marker, further spaces kept, and line feeds with the
    word part behind them."""
    text = text.replace(MARK, " ")
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or parts[0][:1] == "\n":
        return [p if p[:1] == "\n" else p[1:] for p in _PARTS.findall(" " + text)]
    return parts


class Codec:
    """Encodes and decodes texts; `data` is the model's protobuf."""

    def __init__(self, data: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = model = parse_model(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [p for p, _, _ in model.pieces]
        plain = not model.charsmap and not model.squeeze_blanks and model.dummy_prefix
        self.separable = model.kind == BPE and plain and model.byte_fallback and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        if self.separable:
            from tokenizers import normalizers

            # Words come marked, so they need no normaliser and no splitting.
            self.words = build(model)
            self.words.normalizer, self.words.pre_tokenizer = normalizers.Sequence([]), None
        else:
            self.words = None
        self.differing = 0
        #: Ids of words as bytes of int32, and the words that decoding does not give back.
        self.cache, self.lossy = {}, set()

    @cached_property
    def tokenizer(self):
        """The tokenizer of whole texts, made where it is needed."""
        return build(self.model)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; where the libraries differ, sentencepiece's."""
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for i, other in enumerate(self.library.encode(texts, num_threads=1)):
            if out[i] != other:
                self.differing += 1
                out[i] = other
        return out

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        # An empty word is a lone marker; a word behind a line feed has no marker of its own.
        marked = [MARK + w.replace(" ", MARK) for w in words]
        chunks = [marked[i : i + CHUNK] for i in range(0, len(marked), CHUNK)]
        found = (e for i in range(0, len(chunks), AT_ONCE) for e in self.words.encode_batch(chunks[i : i + AT_ONCE], is_pretokenized=True, add_special_tokens=False))
        for i, e in enumerate(found):
            part, ids = words[i * CHUNK : (i + 1) * CHUNK], np.array(e.ids, np.int32)
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(part)), "right").tolist()
            starts = [0, *ends[:-1]]
            flat = e.ids
            lists = [flat[s:t] for s, t in zip(starts, ends)]
            if [x if w else x[:0] for w, x in zip(part, lists)] != self.library.encode(part, num_threads=1):
                raise ValueError("the rebuilt model differs from sentencepiece")
            for word, text in zip(part, self.words.decode_batch(lists, skip_special_tokens=False)):
                if text != word:
                    self.lossy.add(word)
            raw = ids.tobytes()
            self.cache.update((w, raw[4 * (s + (w[:1] == "\n")) : 4 * t]) for w, s, t in zip(part, starts, ends))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text as bytes of int32, and whether decoding them gives the text again."""
        if not self.separable:
            found = self.whole(texts)
            back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            return [(array("i", ids).tobytes(), b == t) for ids, b, t in zip(found, back, texts)]
        cache, parts = self.cache, [words_of(text) if text else [] for text in texts]
        new = {w for p in parts for w in p if w not in cache}
        if len(cache) + len(new) > CACHED:
            cache.clear()
            self.lossy.clear()
            new = set().union(*parts)
        self._learn(list(new))
        out = [(b"".join(map(cache.__getitem__, p)), self.lossy.isdisjoint(p) and MARK not in t) for p, t in zip(parts, texts)]
        for w in new if len(cache) <= CACHED else list(cache):
            if len(w) > CACHED_CHARS or len(cache) > CACHED:
                del cache[w]
                self.lossy.discard(w)
        return out

    def decode(self, rows: list[list[int]]) -> list[str]:
        return (self.words or self.tokenizer).decode_batch(rows, skip_special_tokens=False)


_LAST: list = []


def codec_of(data: bytes) -> Codec:
    """The codec of a model; a worker keeps its last one, with the words it knows, from task to task."""
    if not _LAST or _LAST[0] != data:
        _LAST[:] = [data, Codec(data)]
    return _LAST[1]


def _model(df: DataFrame, model_path: str):
    """The model, broadcast: its size is that of one file and does not grow with the data."""
    with open(model_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _with(df: DataFrame, target: str, kind: str):
    if target in df.columns:
        raise ValueError(f"the input has a column {target}")
    return df.withColumn(target, F.expr(f"CAST(NULL AS {kind})")).schema


def encode(docs: DataFrame, model_path: str, text_col: str = "text", target: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, without begin and end. A null or empty text has no ids.
    Rows, nulls and other columns stay; a clashing target column raises. No rows give no rows."""
    import numpy as np

    shared, at, schema = _model(docs, model_path), docs.columns.index(text_col), _with(docs, target, "array<int>")

    def run(batches):
        codec = codec_of(shared.value)
        for batch in sliced(batches, at):
            found = [np.frombuffer(ids, np.int32) for ids, _ in codec.encode([t or "" for t in batch.column(at).to_pylist()])]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, target])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", target: str = "decoded") -> DataFrame:
    """rows with the text of ids; null ids give null. A clashing target column raises."""
    shared, at, schema = _model(rows, model_path), rows.columns.index(ids_col), _with(rows, target, "string")

    def run(batches):
        codec = codec_of(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                ids = batch.column(at).to_pylist()
                texts = iter(codec.decode([x for x in ids if x is not None]))
                out = pa.array([None if x is None else next(texts) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, target])

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (ids, comma-joined) and round_trip (decoding
    gives the text again). Null texts count as empty; other columns are ignored, whatever their
    names. Ids stay in the worker that makes them."""
    import numpy as np

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = _model(docs, model_path)

    def run(batches):
        codec, texts = codec_of(shared.value), {}
        for batch in sliced(batches, 1):
            n, digests, same = [], [], []
            for ids, back in codec.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(ids, np.int32).tolist()
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join([texts.get(i) or texts.setdefault(i, str(i)) for i in ids]).encode()).hexdigest())
                same.append(back)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["id", "n_tokens", "ids_sha256", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
