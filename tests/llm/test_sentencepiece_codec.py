import hashlib
import math
import random
import struct

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from motifspark.llm.sentencepiece_codec import BYTE, CONTROL, UNKNOWN, Codec, decode, digest, encode, parse_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(pieces, kind, byte_fallback, squeeze):
    """A model's protobuf, written by hand."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    message = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    number = lambda number, n: varint(number << 3) + varint(n)
    out = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in pieces)
    return out + message(2, number(3, kind) + number(35, byte_fallback)) + message(3, message(1, b"identity") + number(3, 1) + number(4, squeeze) + number(5, 1))


def unigram(byte_fallback, squeeze):
    """The shipped model's pieces with scores of a unigram, in which many sums are equal."""
    with open(PATH, "rb") as file:
        pieces = parse_model(file.read()).pieces
    kept = [(p, 0.0 if k in (UNKNOWN, CONTROL, BYTE) else -round(4 + math.log(2 + i), 1), k) for i, (p, _, k) in enumerate(pieces) if byte_fallback or k != BYTE]
    return model_bytes(kept, 1, byte_fallback, squeeze)


def odd_texts():
    rng = random.Random(3)
    letters = [" ", "\n", "a", "B", "▁", "é", "the", "  ", "\t", "1", "１", "<s>", "</s>", "<unk>", "<0x0A>", "\r\n", "日", "\x00", "😀", "aaa", "ing", "$", "#"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["a" * 3000, "word " * 5000, " ", "", "  a", "a  ", "a \n", "\n", "\n\n a", "$$$", "###"]


def documents():
    return pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()


def ids_of(codec, texts):
    return [list(struct.unpack(f"{len(b) // 4}i", b)) for b, _ in codec.encode(texts)]


def test_words_give_the_library_ids():
    with open(PATH, "rb") as file:
        codec = Codec(file.read())
    assert codec.separable
    texts = odd_texts() + documents()
    found = codec.encode(texts)
    assert ids_of(codec, texts) == codec.library.encode(texts)
    assert codec.decode(ids_of(codec, texts)) == [t if same else t.replace("▁", " ") for t, (_, same) in zip(texts, found)]
    assert {same for t, (_, same) in zip(texts, found) if "▁" not in t} == {True}


def test_whole_texts_give_the_library_ids():
    # The rebuilt pipeline itself, without words apart.
    with open(PATH, "rb") as file:
        codec = Codec(file.read())
    assert codec.whole(odd_texts() + documents()) and codec.differing == 0


@pytest.mark.parametrize("byte_fallback", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_models(byte_fallback, squeeze):
    codec = Codec(unigram(byte_fallback, squeeze))
    assert not codec.separable
    texts = documents()[:300]
    assert ids_of(codec, texts) == codec.library.encode(texts)
    assert codec.differing  # equal sums, which the two libraries break apart differently


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr("motifspark.llm.sentencepiece_codec.CACHED", 50)
    with open(PATH, "rb") as file:
        codec = Codec(file.read())
    texts = documents()[:100]
    assert ids_of(codec, texts) == codec.library.encode(texts)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there\n", 5), (2, None, 5), (2, "", 5), (None, "a▁b", 5), (None, "a▁b", 5), (7, "word " * 200_000, 5)], "doc_id long, text string, n_tokens int")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [(i, len(ids := model.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "▁" not in (t or "")) for i, t, _ in map(tuple, docs.collect())]
    assert sorted(map(tuple, digest(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert digest(docs.limit(0), PATH).count() == 0
    back = decode(encode(docs, PATH), PATH)
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for row in back.collect():
        assert row.ids == model.encode(row.text or "") and row.decoded == (row.text or "").replace("▁", " ")
    with pytest.raises(ValueError):
        encode(docs.withColumnRenamed("n_tokens", "ids"), PATH)
