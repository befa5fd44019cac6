import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from motifspark.llm.token_counts import TokenCounter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library_on_odd_texts():
    model, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(3)
    letters = [" ", "\n", "a", "B", "▁", "é", "the", "  ", "\t", "1", "１", "<s>", "\r\n", "日", "\x00", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + ["a" * 5000, "word " * 5000]
    counter = TokenCounter(PATH, {b"the": 1})
    assert counter.separable
    assert counter.count([t.encode() for t in texts]) == [len(model.encode(t)) for t in texts]


def test_rows_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 0)], "doc_id long, text string, n_tokens int")
    out = token_counts(docs, PATH, limit=1)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 0, 0, False), (2, 0, 0, False)], key=str)
    assert token_counts(docs.where(F.lit(False)), PATH).count() == 0
