"""Quality rules (operator 5) as weak supervision, in DataFrame functions only.

Each rule votes bad (1), good (0) or abstains (null). Documents are counted by their pattern of
votes: there are at most 3^len(RULES) patterns, whatever the input's size. Expectation-maximisation
over these counts estimates how often each rule's votes are right; the posterior that a
document is good is then a column expression of its votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, packed, table, unpacked

_BLANK = r"[\\x20\\x09-\\x0D]"
_WINDOW = 8

#: name: vote over the statistics of `measure`. Rules for faults vote bad or abstain; the last two vote
#: good or abstain.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN 1 END",
    "repeats": "CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 1 END",
    "symbols": "CASE WHEN 100 * n_symbols > 30 * n_words THEN 1 END",
    "lines": "CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 1 END",
    "word_size": "CASE WHEN word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words THEN 1 END",
    "capitals": "CASE WHEN 100 * n_upper > 50 * word_chars THEN 1 END",
    "shouting": "CASE WHEN 100 * n_marks > 50 * n_words THEN 1 END",
    "prose": "CASE WHEN n_words >= 20 AND 100 * n_symbols <= 5 * n_words AND 100 * n_upper <= 20 * word_chars AND word_chars BETWEEN 3 * n_words AND 9 * n_words THEN 0 END",
    "variety": "CASE WHEN n_words >= 20 AND 100 * n_repeat_words <= 10 * n_words AND 100 * n_dup_lines <= 5 * n_lines AND 100 * n_marks <= 10 * n_words AND 100 * n_symbols <= 5 * n_words THEN 0 END",
}
#: Documents whose posterior of being good is below this are rejected.
LEAST_POSTERIOR = 0.5
ITERATIONS = 50
#: Accuracy of each rule at the start, and its bounds: a vote never speaks for the other side. Both
#: classes count as equally likely before the votes, so that the share of bad documents in one corpus
#: does not decide over a document.
ACCURACY, LEAST_ACCURACY, MOST_ACCURACY = 0.8, 0.55, 0.99


def _repeated(keyed: str) -> str:
    """Places p, ascending, of an array of (k, p) whose k occurs twice or more."""
    return f"""transform(array(sort_array({keyed})), s -> sort_array(filter(transform(sequence(0, size(s) - 1), j ->
      CASE WHEN get(s, j).k = get(s, j - 1).k OR get(s, j).k = get(s, j + 1).k THEN get(s, j).p END), p -> p IS NOT NULL)))[0]"""


def repeat_words(words: str, window: int = _WINDOW) -> Column:
    """Words that stand in windows found twice or more: windows are keyed by hash, those of repeated
    hashes by their words, so equal hashes of different words do no harm. One-element arrays bind
    what is used more than once."""
    hashed = f"transform(sequence(0, size(w) - {window}), i -> named_struct('k', xxhash64(slice(w, i + 1, {window})), 'p', i))"
    exact = f"transform(c, i -> named_struct('k', array_join(slice(w, i + 1, {window}), ' '), 'p', i))"
    covered = f"aggregate(transform(sequence(0, size(q) - 1), j -> least({window}, coalesce(get(q, j + 1) - get(q, j), {window}))), 0L, (n, x) -> n + x)"
    inner = f"transform(array({_repeated(exact)}), q -> CASE WHEN size(q) = 0 THEN 0L ELSE {covered} END)[0]"
    body = f"transform(array({_repeated(hashed)}), c -> CASE WHEN size(c) = 0 THEN 0L ELSE {inner} END)[0]"
    return F.expr(f"transform(array({words}), w -> CASE WHEN size(w) <= {window} THEN 0L ELSE {body} END)[0]")


def measure() -> dict[str, Column]:
    """Statistics of the column `_text`, in the order in which they may be added."""
    split = f"filter(split(_text, '{_BLANK}+'), w -> w <> '')"
    lines = f"filter(split(_text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    kept = lambda chars: F.expr(f"CAST(length(regexp_replace(_text, '{chars}', '')) AS LONG)")
    counts = f"transform(array({lines}), l -> array(size(l), size(l) - size(array_distinct(l))))[0]"
    return {
        "n_words": F.expr(f"CAST(size({split}) AS LONG)"),
        "word_chars": kept(_BLANK + "+"),
        "n_symbols": kept("[^#*$%&|<>]+"),
        "n_upper": kept(r"\\P{Lu}+"),
        "n_marks": kept("[^!?]+"),
        "_lines": F.expr(counts),
        "n_repeat_words": repeat_words(split),
    }


def estimate(patterns: list[tuple[tuple, int]], iterations: int = ITERATIONS) -> list[float]:
    """Accuracy of each rule where it votes, by expectation-maximisation over counted vote patterns.
    Each rule starts with, and keeps, one pseudo-vote of accuracy ACCURACY."""
    accuracies = [ACCURACY] * (len(patterns[0][0]) if patterns else len(RULES))
    for _ in range(iterations):
        right, cast = [ACCURACY] * len(accuracies), [1.0] * len(accuracies)
        for votes, n in patterns:
            good = 1 / (1 + math.exp(-log_odds_good(votes, accuracies)))
            for r, vote in enumerate(votes):
                if vote is not None:
                    right[r] += n * (1 - good if vote else good)
                    cast[r] += n
        accuracies = [min(MOST_ACCURACY, max(LEAST_ACCURACY, a / b)) for a, b in zip(right, cast)]
    return accuracies


def log_odds_good(votes, accuracies) -> float:
    return sum((-1 if vote else 1) * math.log(a / (1 - a)) for vote, a in zip(votes, accuracies) if vote is not None)


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, rules: dict[str, str] = RULES, least: float = LEAST_POSTERIOR, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) as the struct `_own`, STATISTICS, base_failed,
    posterior and kept."""
    rows = docs.select(packed(docs.columns if keep is None else keep), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_own", *(c.alias(n) for n, c in measure().items()))
    rows = rows.withColumns({"n_lines": F.expr("CAST(_lines[0] AS LONG)"), "n_dup_lines": F.expr("CAST(_lines[1] AS LONG)")}).drop("_lines")
    rows = cut(rows)
    votes = F.array(*(F.expr(v) for v in rules.values()))
    patterns = sorted(((tuple(r["v"]), r["n"]) for r in rows.groupBy(votes.alias("v")).agg(F.count("*").alias("n")).collect()), key=repr)
    log_odds = F.lit(0.0)
    for vote, accuracy in zip(rules.values(), estimate(patterns)):
        weight = math.log(accuracy / (1 - accuracy))
        log_odds = log_odds + F.when(F.expr(vote) == 1, -weight).when(F.expr(vote) == 0, weight).otherwise(0.0)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return rows.withColumns({"base_failed": failed, "posterior": F.round(1 / (1 + F.exp(-log_odds)), 6)}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def judge(docs: DataFrame, rules: dict[str, str] = RULES, least: float = LEAST_POSTERIOR, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with STATISTICS, base_failed, posterior and kept.

    A null or empty text has no words and fails. Repeated rows and null ids are kept as they are. A
    new column whose name `keep` has already gets an underscore behind it. An empty input gives no
    rows.
    """
    columns = docs.columns if keep is None else keep
    return unpacked(judged(docs, rules, least, text_col, columns), columns, [*STATISTICS, "base_failed", "posterior", "kept"])


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, whatever their names."""
    return unpacked(judged(docs, **options).where("kept"), docs.columns, [])


def op5_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_statistics(spark, sf_dir):
    """The columns of op5_quality_rules that SQL can express."""
    return op5_quality_rules(spark, sf_dir).drop("kept")


STATISTICS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS l FROM t),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {_WINDOW} + 2)) AS a FROM d WHERE len(w) > {_WINDOW}),
g AS (SELECT doc_id, list(a) AS a FROM (SELECT doc_id, a, array_to_string(w[a : a + {_WINDOW - 1}], ' ') AS win FROM p) GROUP BY doc_id, win HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(a, a + {_WINDOW})) AS place FROM (SELECT doc_id, unnest(a) AS a FROM g)) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""
