import hashlib
import random
import re

import duckdb
import pytest

from motifspark.llm.document_fingerprints import LEAST_SHARE, LEVELS, MOST_SHARE, ORACLE_SQL, SUBSETS, fingerprinted, likeness, op13_document_fingerprints

SCHEMA = "doc_id long, text string"


def terms(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(text, known):
    """(level, coarse, fine) by looking at every term for every subset."""
    own = terms(text)
    if not own:
        return None
    level = max(0, min(LEVELS - 1, len(own).bit_length() - 2))
    code = {t: hashlib.sha256(t.encode()).hexdigest() for t in own}
    inside = lambda t, n, at: at == 0 or int(code[t][4 * n : 4 * n + 4], 16) < 1 << 16 - at
    picked = {t for t in own if any(inside(t, n, level) for n in range(SUBSETS))}
    picked = picked & known or picked
    digest = lambda n, at: hashlib.md5(" ".join(s).encode()).hexdigest()[:6] if (s := sorted((t for t in picked if inside(t, n, at)), key=str.encode)) else ""
    return level, *([digest(n, at) for n in range(SUBSETS)] for at in (level, level + 1))


def lexicon(texts):
    count = {}
    for t in texts:
        for w in terms(t):
            count[w] = count.get(w, 0) + 1
    return {w for w, n in count.items() if LEAST_SHARE * len(texts) <= n <= MOST_SHARE * len(texts)}


def written(f):
    return "" if f is None else f"{f[0]}:{','.join(f[1])};{','.join(f[2])}"


def alike(a, b):
    if a == b:
        return 1.0
    if a is None or b is None or abs(a[0] - b[0]) > 1:
        return 0.0
    x, y = {0: (2, 2), -1: (2, 1), 1: (1, 2)}[a[0] - b[0]]
    pairs = [p for p in zip(a[x], b[y]) if any(p)]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def brute_rows(rows):
    """The rows of op13 for rows of distinct ids, null at most once and last."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    known, out = lexicon([t for _, t in rows]), []
    for n, (i, text) in enumerate(rows):
        after, cut = rows[(n + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (brute(t, known) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), alike(a, b), alike(a, c)))
    return sorted(out, key=str)


def texts_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"Word{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.choice([0, 1, 3, 12, 60, 400]))) for _ in range(n)]
    return [None, "", " .,!\n", "日本 日本", "İstanbul ẞ ﬁ A", *texts, *texts[:5], "x" * 9000, "one " * 5000, " ".join(f"t{i}" for i in range(5000))]


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 7)])
def test_equals_brute_force(spark, tmp_path, seed, partitions):
    texts = texts_of(seed, 120)
    rows = [(3 * i - 50 if i else None, t, "own", i) for i, t in enumerate(texts)]
    random.Random(seed).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA + ", fingerprint string, bucket int").repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_document_fingerprints(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == brute_rows([r[:2] for r in rows])


def test_repeated_ids_single_and_no_rows(spark, tmp_path):
    found = {}
    for name, rows in {"none": [], "one": [(4, "a b c d e f g h")], "same": [(4, "a b c d")] * 30, "ids": [(4, f"t{i % 3} u v w") for i in range(30)]}.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found[name] = op13_document_fingerprints(spark, f"{tmp_path}/{name}").collect()
    assert [len(x) for x in found.values()] == [0, 1, 30, 30]
    assert {(r["near_edited"], r["near_next"]) for r in found["one"]} == {(brute_rows([(4, "a b c d e f g h")])[0][5], 1.0)}
    assert {r["near_next"] for r in found["same"]} == {1.0} and len({r["fingerprint"] for r in found["same"]}) == 1
    assert len({r["fingerprint"] for r in found["ids"]}) == 3


def test_operator_keeps_columns_and_tells_near_copies_from_others(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.sample(words, 150) for _ in range(60)]
    near = [t[:140] + rng.sample(words, 10) for t in base]
    rows = [(i, " ".join(t), f"own{i}", i) for i, t in enumerate(base + near)]
    out = fingerprinted(spark.createDataFrame(rows, SCHEMA + ", fingerprint string, row int"))
    assert out.columns == ["doc_id", "text", "fingerprint", "row", "fingerprint_"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(found[i]["fingerprint"] == f"own{i}" for i in range(120))
    known = lexicon([r[1] for r in rows])
    prints = [brute(r[1], known) for r in rows]
    assert [found[i]["fingerprint_"] for i in range(120)] == [written(f) for f in prints]
    assert min(alike(prints[i], prints[60 + i]) for i in range(60)) > 0.5
    assert max(alike(prints[i], prints[j]) for i in range(60) for j in range(i)) < 0.35


def test_likeness(spark):
    kind = "struct<level:int,coarse:array<string>,fine:array<string>>"
    rng = random.Random(9)
    some = lambda: None if rng.random() < 0.1 else (rng.randrange(4), [rng.choice(["", "a", "b"]) for _ in range(4)], [rng.choice(["", "a", "b"]) for _ in range(4)])
    pairs = [(some(), some()) for _ in range(300)] + [(None, None)]
    out = spark.createDataFrame(pairs, f"a {kind}, b {kind}").select(likeness("a", "b")).collect()
    assert [r[0] for r in out] == [alike(*p) for p in pairs]


@pytest.mark.parametrize("sf", ["sf0.001", "fixture"])
def test_equals_its_sql(spark, tmp_path, sf):
    path = f"/root/testdata/{sf}"
    if sf == "fixture":
        path = str(tmp_path)
        spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts_of(5, 60))], SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{'/*.parquet' if sf == 'fixture' else ''}'")
    wanted = con.execute(ORACLE_SQL)
    columns = [c[0] for c in wanted.description]
    out = op13_document_fingerprints(spark, path)
    assert out.columns == columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted.fetchall(), key=str)
