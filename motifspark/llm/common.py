"""Shared helpers: table access, lineage cuts, word rules."""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to a Python worker; texts may be long, so it is small.
BATCH_ROWS = 1000

#: ASCII white space of the word rule [^\x20\x09-\x0D]+; bytes.split() splits on exactly these.
BLANKS = r"[\x20\x09-\x0D]+"

#: bytes.translate table of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z:
#: digits, a-z and all non-ASCII bytes stay, everything else turns into a space.
ALNUM = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Bytes of text that a worker turns into Python objects at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def sliced(batches, column: int, size: int = SLICE_BYTES):
    """The batches in parts whose strings in `column` take at most `size` bytes, or of one row. Spark
    itself bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local
    session, whose executor is the driver, gets a temporary one; a cluster must name its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/motifspark-checkpoints"


#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Share of the driver's largest heap beyond which cut() lets go of what is not needed any more.
HEAP_SHARE = 2 / 3


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it again: the lineage ends there, a lost
    executor loses nothing, and what stands above is not computed twice. The table goes with discard(),
    or else when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/motifspark/{uuid.uuid4().hex}"
    # What the write shuffled is not needed after it, so it need not fill the executors' disks.
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    files, there = _store(df.sparkSession, path)
    files.deleteOnExit(there)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    # Plans that have run are garbage; collected before the driver's heap is full, they do not make it grow.
    runtime = df.sparkSession._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        release(df.sparkSession)
    return out


def _store(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def discard(*cuts: DataFrame) -> None:
    """Delete tables that cut() wrote; nothing may read them any more."""
    for df in cuts:
        files, there = _store(df.sparkSession, df._cut)
        files.delete(there, True)


def release(spark: SparkSession) -> None:
    """Let go of what earlier executions left: the broadcasts and shuffles that no DataFrame refers to any
    more are removed from driver and executors once the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def packed(columns: list[str]):
    """The columns as one struct `_own`, so that no name of theirs can clash with an operator's."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in columns) if columns else [F.lit(None).alias("_none")]).alias("_own")


def unpacked(rows: DataFrame, columns: list[str], new: list[str]) -> DataFrame:
    """The packed columns and the new ones; a new name that the columns have gets underscores behind it."""
    taken, out = {c.lower() for c in columns}, [F.col("_own")[c].alias(c) for c in columns]
    for name in new:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(F.col(name).alias(free))
    return rows.select(out)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: A key with at least 1/HOT of all rows is hot; there are at most HOT of them.
HOT = 1000


def lookup(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of rows with groups, which has one row per non-null key and its number of rows in
    `count`. The at most HOT keys with a share of 1/HOT of `total` or more are broadcast, so that no
    task gets a hot key; the others are joined by a shuffle. Rows of null keys find nothing.
    """
    bound = max(1, -(-total // HOT))
    hot = groups.where(F.col(count) >= bound)
    cold = groups.where(F.col(count) < bound).withColumnRenamed(key, "_key")
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col("_hot").eqNullSafe(F.col(key)), "left")
    spread = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key))
    direct = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key)
    shuffled = marked.where(spread.isNotNull()).drop("_hot").join(cold, F.col(key) == F.col("_key"), "left").drop("_key")
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name != key))
    names = [*rows.columns, *(c for c in groups.columns if c != key)]
    return direct.select(names).unionByName(shuffled.select(names)).unionByName(none.select(names))
