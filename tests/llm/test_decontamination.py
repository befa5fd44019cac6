import random
import re

from motifspark.llm.decontamination import Automaton, decontaminate, find_contamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(doc, items, window):
    hit, found = set(), set()
    for name, item in items:
        for i in range(max(1, len(item) - window + 1) if item else 0):
            w = item[i : i + window]
            for j in range(len(doc) - len(w) + 1):
                if doc[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(name)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        window = rng.randint(1, 5)
        pick = lambda n: [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, n))]
        items = [(str(i), pick(9)) for i in range(rng.randint(0, 5))]
        doc = pick(30)
        spans, found = Automaton(items, window).match(doc)
        assert ({i for s, e in spans for i in range(s, e)}, found) == brute(doc, items, window)


def test_blocks_nulls_and_removal(spark):
    benchmark = spark.createDataFrame([(1, "One two, three four"), (2, None), (3, "x y"), (4, ""), (3, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é ONE two-three; four é é!", 1), (2, None, 1), (3, "", 1), (4, "X y", 1), (5, "clean text", 1)], "doc_id long, text string, n_words int")
    found = {r["doc_id"]: r for r in find_contamination(docs.drop("n_words"), benchmark, window=3, block_words=3).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 5)] and found[1]["items"] == ["1"] and found[1]["n_words"] == 7
    assert found[4]["items"] == ["3"] and not found[5]["items"] and found[2]["n_words"] == found[3]["n_words"] == 0
    out = {r["doc_id"]: r for r in decontaminate(docs, benchmark, window=3).collect()}
    assert out[1]["text"] == "é  é é!" and out[5]["text"] == "clean text" and 4 not in out and out[2]["text"] is None and out[1]["n_words"] == 1
    assert decontaminate(docs.limit(0), benchmark.limit(0)).count() == 0


def test_clashing_columns_stay(spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(9, "k", "x a b c y z q r", 7, "s", None), (8, None, "z", 7, "s", None), (9, "k", "x a b c y z q r", 7, "s", None)], "n_words long, items string, text string, doc_id long, spans string, _own int")
    out = decontaminate(docs, benchmark, window=3)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == ["x  y z q r"] * 2 + ["z"]
    found = find_contamination(docs, benchmark, window=3)
    assert found.columns == [*docs.columns, "n_words_", "spans_", "items_"] and {(r["n_words"], r["n_words_"], tuple(r["items_"])) for r in found.collect()} == {(9, 8, ("1",)), (8, 1, ())}
