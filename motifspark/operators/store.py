"""A keyed store of patterns as a table (key, value): lookups, upserts, deletions and prefix walks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retrieve(store: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with `value`, null where the store lacks the key."""
    return keys.join(store.select("key", "value"), "key", "left")


def store_all(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after the rows of new; they replace what was under their keys. Of equal new keys the
    largest value stays; rows of null keys are left out."""
    latest = new.where("key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
    return store.select("key", "value").join(latest.select("key"), "key", "left_anti").unionByName(latest)


def store_if_absent(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the rows of new whose keys it lacks."""
    return store_all(store, new.join(store.select("key"), "key", "left_anti"))


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def enumerate_keys(store: DataFrame) -> DataFrame:
    """All rows by key."""
    return store.select("key", "value").orderBy("key")


def walk(store: DataFrame, prefix: str) -> DataFrame:
    """(symbol, keys, terminal) of the symbols that may follow the prefix: how many keys go on that way,
    and whether the prefix with the symbol is a key itself. The prefix is a filter on the scan."""
    symbol = F.substring("key", len(prefix) + 1, 1).alias("symbol")
    rows = store.where(F.col("key").startswith(prefix) & (F.length("key") > len(prefix)))
    return rows.groupBy(symbol).agg(F.count("*").alias("keys"), F.max((F.length("key") == len(prefix) + 1).cast("int")).cast("boolean").alias("terminal"))


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a saved store that have been committed, ascending."""
    files, log = _folder(spark, f"{path}/log")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(log)) if files.exists(log) else []


def save(store: DataFrame, path: str, keep: int = 2) -> int:
    """A new version of the store at path, whose number is returned; the last `keep` versions stay.

    Its files are written first, each a range of sorted keys, so that a filter on a prefix reads the files of
    that prefix only. Then one small file, created only if it is not there, makes the version the
    current one: a run that dies before that leaves the one before it, readers see whole versions, and of two
    savers at once the second raises. So what was loaded from path may be saved to it."""
    if keep < 1:
        raise ValueError("keep must be positive")
    spark = store.sparkSession
    before = versions(spark, path)
    number = before[-1] + 1 if before else 0
    name = f"data/{number:012d}-{uuid.uuid4().hex}"
    store.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/{name}")
    files, pointer = _folder(spark, f"{path}/log/{number:012d}")
    out = files.create(pointer, False)
    out.write(bytearray(name.encode()))
    out.close()
    for old in before[: max(0, len(before) + 1 - keep)]:
        data = _folder(spark, f"{path}/{_name(spark, path, old)}")[1]
        files.delete(_folder(spark, f"{path}/log/{old:012d}")[1], False)
        files.delete(data, True)
    return number


def _name(spark: SparkSession, path: str, version: int) -> str:
    return spark.read.text(f"{path}/log/{version:012d}").first()[0]


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of a saved store, or one of those that are kept."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise ValueError("there is no such store or version")
    return spark.read.parquet(f"{path}/{_name(spark, path, found[-1] if version is None else version)}").select("key", "value")
