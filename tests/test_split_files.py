"""Files that are read in ranges of bytes, held against the same texts in memory."""

import random

import pytest

from motifspark.operators.search import kmismatch
from motifspark.sources import files
from motifspark.sources.split_files import kmismatch_files, read_pieces

#: One, two, three and four bytes in UTF-8.
LETTERS = "abé日𝄞\n"


def _written(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return {f"{folder}/{name}": text.removesuffix("\n") for name, text in texts.items()}


def test_pieces_cover_each_file_once(spark, tmp_path):
    rng = random.Random(5)
    texts = _written(tmp_path, {f"t{i}": "".join(rng.choices(LETTERS, k=size)) for i, size in enumerate((0, 1, 7, 133))} | {"feed": "\n", "_hidden": "x"})
    texts.pop(f"{tmp_path}/_hidden")
    for row_bytes, overlap in ((5, 3), (64, 9)):
        pieces = read_pieces(spark, str(tmp_path), overlap, split_bytes=16, row_bytes=row_bytes).collect()
        for path, text in texts.items():
            own = sorted((p for p in pieces if p.text_id == path and p.owned), key=lambda p: p.base)
            assert "".join(p.text[: p.owned] for p in own) == text
            assert all(p.text == text[p.base : p.base + p.owned + overlap] for p in own)
        assert {p.text_id for p in pieces if p.owned} == {path for path, text in texts.items() if text}


def test_matches_equal_those_of_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    texts = _written(tmp_path, {f"t{i}": "".join(rng.choices(LETTERS[:4], k=400)) for i in range(3)})
    some = list(texts.values())
    patterns = spark.createDataFrame([(i, some[i % 3][9 * i : 9 * i + 5 + i]) for i in range(8)] + [(8, "a"), (9, None), (10, "")], "pattern_id long, pattern string")
    whole = spark.createDataFrame(list(texts.items()), "text_id string, text string")
    for k, circular in ((0, False), (2, False), (1, True)):
        want = sorted(map(tuple, kmismatch(whole, patterns, k, circular).collect()))
        found = kmismatch_files(spark, sorted(texts), patterns, k, circular, split_bytes=32, row_bytes=16)
        assert want and sorted(map(tuple, found.collect())) == want


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    text = "abcdefg " * 4000
    (tmp_path / "one").write_text(text)
    pieces = read_pieces(spark, f"{tmp_path}/one", 3, split_bytes=4000, row_bytes=1000)
    assert pieces.count() == 32
    assert spark.read.format("split_text").options(uris=f'["{tmp_path}/one"]', overlap=3, split_bytes=4000, row_bytes=1000, only="all").load().rdd.getNumPartitions() == 8
    assert files.read_texts(spark, f"{tmp_path}/one").count() == 1


def test_odd_files(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"\x80" * 50 + b"ab\xff" + b"\xbf" * 11)
    pieces = read_pieces(spark, str(tmp_path), 4, split_bytes=8, row_bytes=8).collect()
    assert "".join(p.text[: p.owned] for p in sorted(pieces, key=lambda p: p.base)) == "�" * 50 + "ab" + "�" * 12
    (tmp_path / "empty").mkdir()
    assert read_pieces(spark, f"{tmp_path}/empty", 0).count() == 0
    patterns = spark.createDataFrame([], "pattern_id long, pattern string")
    assert kmismatch_files(spark, str(tmp_path), patterns, 1).count() == 0
    with pytest.raises(ValueError):
        read_pieces(spark, str(tmp_path), -1)
    with pytest.raises(Exception, match="nowhere"):
        read_pieces(spark, f"{tmp_path}/nowhere", 0).count()
