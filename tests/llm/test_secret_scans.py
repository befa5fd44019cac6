import random
import re
import time

from pyspark.sql import functions as F

from motifspark.llm.secret_scans import NEEDS, ORDER, PART, SCOPE, redact, scan

PATTERNS = [
    (0, re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    (1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (2, re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    return sorted((m.start(), rank, m.end()) for rank, p, g, n in PATTERNS for m in p.finditer(text) if len(m[g]) >= n)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["token", "SECRET", "api_key", "=", ": ", '"', "AKIA", "A9" * 9, "0123456789abcdef", "é", " ", "\n", "x.y", "passwd", "日"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)] + ["secret:token:abcdefgh", ""]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    for r in scan(docs).collect():
        assert [tuple(s) for s in r["base"]] == brute(r["text"] or ""), r["text"]


def test_weak_parts_are_reported_together_only(spark):
    key = "aB3" * 9
    texts = {1: f"user: bob and {key}", 2: "user: bob only", 3: key, 4: "user: bob" + " x" * 300 + key, 5: f"https://db.example.org:5432 {key}", 6: "https://example.org"}
    out = {r["doc_id"]: [s["rank"] for s in r["spans"]] for r in scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out == {1: [3, 4], 2: [], 3: [], 4: [], 5: [5, 4], 6: []}
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=" + "0123456789abcdef" * 2 + " end"), (2, "clean"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in scan(docs).select("doc_id", redact("text", "spans").alias("t")).collect()}
    assert out == {1: "é [SECRET] end", 2: "clean", 3: None}


WEAK = [
    (3, re.compile(r"""\b(?ai:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", re.A), 1, 3),
    (4, re.compile(r"""(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"""), 0, 20),
    (5, re.compile(r"""\b(?:[a-z][a-z0-9+]{0,15}://[^\s"'<>]+|(?ai:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]+)""", re.A), 0, 8),
]


def brute_spans(text):
    """All spans, by comparing every weak candidate with every other part."""
    base = brute(text)
    weak = [(m.start(), rank, m.end()) for rank, p, g, n in WEAK for m in p.finditer(text) if len(m[g]) >= n]
    part = lambda s: PART[ORDER[s[1]]]
    ends = [s for s in base + weak if part(s) == "endpoint"]
    places = [s for s in base + weak if part(s) == "endpoint" or not any(e[0] <= s[0] < e[2] for e in ends)]

    def linked(w):
        return any(part(o) in NEEDS[ORDER[w[1]]] and o[0] < w[2] + SCOPE and o[2] > w[0] - SCOPE and (o[0] >= w[2] or o[2] <= w[0]) for o in places)

    return sorted(base + [w for w in weak if w in places and linked(w)])


def test_all_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["user: bob", "login=ann@x.org", "aB3" * 9, "https://db.example.org:5432/a?token=abcdef1", "host = db-1.internal", "token=abcdefgh", "0123456789abcdef" * 2, "AKIA" + "B7" * 9, " filler " * 12, "\n", ", "]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    # Repeated rows and ids, and columns with the names of the new ones.
    rows = [(i // 2, t, "own", i) for i, t in enumerate(texts + texts[:20])]
    out = scan(spark.createDataFrame(rows, "doc_id long, text string, base string, row int"))
    assert out.columns[:4] == ["doc_id", "text", "base", "row"] and len(out.columns) == 6
    found = sorted((r["row"], [tuple(s) for s in r[5]]) for r in out.collect())
    assert found == [(i, brute_spans(t)) for _, t, _, i in rows]
    assert any(len(s) > 2 for _, s in found)


def test_time_is_in_proportion_to_long_texts(spark):
    def seconds(n):
        runs = ["a+" * n, "a1" * n, "A+9" * n, "user " * n, "AKIA" * n, "token:" * n, "0123456789abcdef" * (n // 8) + "g", "http:" * n]
        docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
        began = time.time()
        scan(docs, keep=["doc_id"]).collect()
        return time.time() - began

    seconds(100)
    # Twenty times the text; quadratic patterns took minutes for a text of this length.
    assert seconds(200_000) < 20 * max(1.0, seconds(10_000))
