"""Text files whose byte ranges are read by several tasks.

A file is one text, as in files.py, but no task reads it whole: it is cut at multiples of `row_bytes`, moved
to where a character begins, and each piece overlaps the next one by as much as a pattern needs.
Files are read through pyarrow's file systems (local folders, hdfs, s3, gs).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motifspark.operators.search import kmismatch

#: Bytes that a task reads, and bytes of one row.
SPLIT_BYTES, ROW_BYTES = 64 << 20, 1 << 20
#: A character takes at most this many bytes in UTF-8.
CHAR_BYTES = 4


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _files(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of a folder's files but hidden ones."""
    from pyarrow import fs

    system, path = _opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    return [(f"{uri.rstrip('/')}/{i.base_name}", i.size) for i in sorted(found, key=lambda i: i.base_name)]


def _edge(data: bytes, at: int) -> int:
    """The first place from `at` on where a character begins or the file ends; `at` itself among bytes that
    are no UTF-8. data ends with the file or reaches beyond at + CHAR_BYTES."""
    for place in range(at, at + CHAR_BYTES):
        if place >= len(data) or data[place] & 0xC0 != 0x80:
            return min(place, len(data))
    return at


class _Split(InputPartition):
    def __init__(self, uri: str, start: int, stop: int):
        self.uri, self.start, self.stop = uri, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uris = json.loads(options["uris"])
        self.overlap, self.split, self.row = (int(options[name]) for name in ("overlap", "split_bytes", "row_bytes"))
        self.sizes = options["only"] == "sizes"

    def partitions(self):
        split = max(1, self.split // self.row) * self.row
        return [_Split(uri, start, min(start + split, size)) for given in self.uris for uri, size in _files(given) for start in range(0, size, split)]

    def read(self, part):
        if part is None:  # no files
            return
        system, path = _opened(part.uri)
        with system.open_input_file(path) as file:
            size = file.size()
            if size:
                file.seek(size - 1)
                size -= file.read(1) == b"\n"
            for start in range(part.start, min(part.stop, size), self.row):
                # As many bytes behind the row as may be needed to find the edges of its last character and overlap.
                file.seek(start)
                data = file.read(min(size - start, self.row + CHAR_BYTES * (self.overlap + 2)))
                begin = _edge(data, 0) if start else 0
                end = max(begin, _edge(data, self.row))
                own = data[begin:end].decode("utf-8", "replace")
                text = None
                if not self.sizes:
                    behind = data[end : _edge(data, end + CHAR_BYTES * self.overlap)].decode("utf-8", "replace")
                    text = own + behind[: self.overlap]
                columns = [pa.array([part.uri]), pa.array([start], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([text], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["text_id", "start", "owned", "text"])


class SplitText(DataSource):
    """Rows (text_id, start, owned, text): the piece at byte `start` owns its first `owned` characters."""

    @classmethod
    def name(cls):
        return "split_text"

    def schema(self):
        return "text_id string, start long, owned long, text string"

    def reader(self, schema):
        return _Reader(self.options)


def _pieces(spark: SparkSession, path: str | list[str], overlap: int, split_bytes: int, row_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (text_id, start, owned, text) and their places (text_id, start, base), which need no text."""
    if overlap < 0 or split_bytes < 1 or row_bytes < CHAR_BYTES:
        raise ValueError(f"overlap must not be negative, split_bytes positive and row_bytes at least {CHAR_BYTES}")
    spark.dataSource.register(SplitText)
    uris = json.dumps([path] if isinstance(path, str) else list(path))
    source = spark.read.format("split_text").options(uris=uris, overlap=overlap, split_bytes=split_bytes, row_bytes=row_bytes)
    before = Window.partitionBy("text_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = source.option("only", "sizes").load().select("text_id", "start", F.coalesce(F.sum("owned").over(before), F.lit(0)).alias("base"))
    return source.option("only", "all").load(), places


def read_pieces(spark: SparkSession, path: str | list[str], overlap: int, split_bytes: int = SPLIT_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(text_id, base, owned, text) of the pieces of files in UTF-8, or of the files of folders, text_id being
    the file's path. A piece begins at character `base` of its file, owns its first `owned` characters,
    which no other piece owns, and has up to `overlap` more. One line feed at a file's end is no data; an
    empty file gives no row; bytes that are no UTF-8 become U+FFFD. Files are read twice, the first time to
    count characters; only a row a piece is sorted for that. A path that is not there raises."""
    pieces, places = _pieces(spark, path, overlap, split_bytes, row_bytes)
    return pieces.join(places, ["text_id", "start"]).select("text_id", "base", "owned", "text")


def kmismatch_files(spark: SparkSession, path: str | list[str], patterns: DataFrame, k: int | None, circular: bool = False, split_bytes: int = SPLIT_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """As operators.search.kmismatch, over files that are read in ranges: (text_id, pattern_id, pos, distance
    [, rotation]), positions in characters of the file. A match over the edges of ranges is found once.
    Pieces are searched where they are read; only matches meet the places of their pieces."""
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 1
    pieces, places = _pieces(spark, path, longest - 1, split_bytes, row_bytes)
    texts = pieces.select(F.struct("text_id", "start", "owned").alias("text_id"), "text")
    found = kmismatch(texts, patterns, k, circular, range_size=None).where("pos < text_id.owned")
    columns = ["distance", *(["rotation"] if circular else [])]
    found = found.select("text_id.text_id", "text_id.start", "pattern_id", "pos", *columns).join(places, ["text_id", "start"])
    return found.select("text_id", "pattern_id", (F.col("pos") + F.col("base")).alias("pos"), *columns)
