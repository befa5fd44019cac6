"""Suffix array, longest common prefixes and extensions of a whole corpus, as joins and range-partitioned sorts.

Prefix doubling: the label of 2^(l+1) characters at a place follows from the labels of 2^l characters there
and 2^l places on. Different pairs of labels are sorted over range partitions, and what numbers them in that
order is the next label; labels keep the order and need not be dense, so no task counts all rows. Each
level is a written table (t, pos, label), spread by place, so one long text is many tasks' work. Tables of
places are joined by shuffles, however small their files are; labels are broadcast while they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifspark.operators.tables import joinable, shuffled, written


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 0, in ascending order: sorted in range partitions, whose sizes alone meet."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted(map(tuple, local.groupBy(part.alias("p")).agg(F.count("*")).collect()))
    before = {p: sum(n for q, n in sizes if q < p) for p, _ in sizes}
    # As many entries as there are range partitions.
    offsets = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return local.withColumn(name, F.element_at(offsets, part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _labelled(pairs: DataFrame) -> DataFrame:
    """(t, pos, label) of rows (t, pos, a, b): labels have the order of (a, b)."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = pairs.select("a", "b").distinct().repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b")
    names = written(names.withColumn("label", F.monotonically_increasing_id()))
    return written(pairs.join(joinable(names), ["a", "b"]).select("t", "pos", "label"))


class CorpusIndex:
    """Labels of all places of texts (text_id, text), by level: level l tells the 2^l characters from a place
    on, as far as the text goes. Rows of repeated or null ids are texts of their own; null and empty
    texts have no places. Characters are code points and have their order."""

    def __init__(self, texts: DataFrame):
        rows = written(texts.select("text_id", "text").where("length(text) > 0").withColumn("t", F.monotonically_increasing_id()))
        self.texts = rows.select("t", "text_id", F.length("text").alias("size"))
        longest = rows.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
        symbols = rows.select("t", F.posexplode(F.expr("regexp_extract_all(text, '(?s).', 0)")).alias("pos", "s"))
        # Code points in their order, UTF-8 having it too.
        self.levels = [_labelled(symbols.select("t", "pos", F.hex(F.encode("s", "UTF-8")).alias("a"), F.lit("").alias("b")))]
        while 1 << (len(self.levels) - 1) < longest:
            here, step = self.levels[-1], 1 << (len(self.levels) - 1)
            on = here.select("t", (F.col("pos") - step).alias("pos"), F.col("label").alias("b"))
            # What has ended comes first.
            pairs = here.withColumnRenamed("label", "a").join(shuffled(on.where("pos >= 0")), ["t", "pos"], "left")
            self.levels.append(_labelled(pairs.select("t", "pos", "a", F.coalesce("b", F.lit(-1)).alias("b"))))

    def suffix_array(self) -> DataFrame:
        """(rank, t, text_id, pos): all suffixes of all texts in their order; equal ones by text, then pos."""
        rows = self.levels[-1].join(shuffled(self.texts.select("t", "text_id")), "t")
        return numbered(rows.select("label", "text_id", "pos", "t"), ["label", "text_id", "pos", "t"], "rank").select("rank", "t", "text_id", "pos")

    def common_extension(self, pairs: DataFrame) -> DataFrame:
        """pairs (t, i, u, j, ...) with `lce`, how far the suffixes at place i of text t and at j of u agree: from
        the largest level down, equal labels move both places on. Two joins a level, whatever the lengths;
        places outside of the texts give 0, null ones null."""
        size = lambda t: shuffled(self.texts.select(F.col("t").alias(t), F.col("size").alias(f"_{t}")))
        rows = pairs.join(size("t"), "t", "left").join(size("u"), "u", "left").withColumn("_n", F.lit(0))
        for level in range(len(self.levels) - 1, -1, -1):
            step, labels = 1 << level, self.levels[level]
            first = labels.select("t", F.col("pos").alias("_x"), F.col("label").alias("_a"))
            second = labels.select(F.col("t").alias("u"), F.col("pos").alias("_y"), F.col("label").alias("_b"))
            rows = rows.withColumns({"_x": F.expr("i + _n"), "_y": F.expr("j + _n")}).join(shuffled(first), ["t", "_x"], "left").join(shuffled(second), ["u", "_y"], "left")
            # Labels tell no end from another's beginning beyond it, so a step is taken inside both texts only.
            inside = F.expr(f"_a = _b AND i + _n + {step} <= _t AND j + _n + {step} <= _u")
            rows = rows.withColumn("_n", F.col("_n") + F.when(inside, step).otherwise(0)).drop("_x", "_y", "_a", "_b")
        return rows.select(*pairs.columns, F.expr("CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN _n END").alias("lce"))

    def lcp_array(self) -> DataFrame:
        """(rank, text_id, pos, lcp): how far each suffix agrees with the one ranked before it; 0 for the first."""
        order = written(self.suffix_array())
        before = order.select((F.col("rank") + 1).alias("rank"), F.col("t").alias("u"), F.col("pos").alias("j"))
        pairs = order.select("rank", "text_id", "t", F.col("pos").alias("i")).join(shuffled(before), "rank", "left")
        return self.common_extension(pairs).select("rank", "text_id", F.col("i").alias("pos"), F.coalesce("lce", F.lit(0)).alias("lcp"))
