"""Stages of the corpus pipeline: quality rules, near duplicates, decontamination, secrets, encoding.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Every stage works on all that the one before it kept.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from motifspark.llm.common import cut, packed, table
from motifspark.llm.decontamination import decontaminate
from motifspark.llm.jaccard_join import jaccard_join
from motifspark.llm.quality_rules import kept_documents
from motifspark.llm.secret_scans import redacted
from motifspark.llm.sentencepiece_codec import digest

#: Near duplicates share this percentage of their shingles of so many words; the limits of
#: op4_jaccard_join hold for that query alone.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return kept_documents(docs)


def _numbered(docs):
    """(_own, id, text, row) of docs: `row` tells rows apart and is the same whenever they are read. Rows of
    a table that is read as it stands have their file and their place in it; all others, of which several may
    come from one row of a file, are written with a row number."""
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns
    if plain:
        try:
            return docs.select(packed(docs.columns), F.col("doc_id").alias("id"), "text", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
        except AnalysisException:  # a source whose rows have no place
            pass
    return cut(docs.select(packed(docs.columns), F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("row")))


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates the row of the smallest id stays, null ids last; of equal
    ids the first row. Rows are told apart by their place in the table, so rows of null or repeated ids
    stay if they are copies of nothing. Columns keep their values, whatever their names."""
    rows = _numbered(docs)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = jaccard_join(rows.select(key.alias("key"), "text"), shingle=NEAR_SHINGLE, percent=NEAR_PERCENT, id_col="key")
    first = groups.where("key.row = component_id.row").select("key.row")
    return rows.join(first.hint("merge"), "row", "left_semi").select(*(F.col("_own")[c].alias(c) for c in docs.columns))


def decontamination(spark, docs, sf_dir):
    """Words of benchmark windows go, and documents that hold little else."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scans(spark, docs, sf_dir):
    """Secrets are replaced by a mark."""
    return redacted(docs)


def encoding(spark, docs, sf_dir):
    """Number and digest of each document's token ids."""
    import public_tokenizers

    return digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding", encoding),
]

#: The votes' expectation-maximisation and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
