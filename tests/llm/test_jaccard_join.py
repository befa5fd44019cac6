import random
import re

import pyarrow.parquet as pq

from motifspark.llm.jaccard_join import Shingler, jaccard_join


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 85 * max(len(sets[i]), len(sets[j])) <= 100 * min(len(sets[i]), len(sets[j])):
                same = len(sets[i] & sets[j])
                if 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def test_chains_of_edits_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for _ in range(6):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 30, 90]))]
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    assert sorted(map(tuple, jaccard_join(docs).collect())) == brute(texts)


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, "z"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join(docs).collect()), key=str) == sorted([(None, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None), (None, 0, None)], key=str)
    assert jaccard_join(docs.limit(0)).count() == 0


def test_documents(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pydict()
    assert texts["doc_id"] == list(range(len(texts["doc_id"])))
    out = jaccard_join(spark.createDataFrame(list(enumerate(texts["text"])), "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == brute(texts["text"])


def test_words_that_polynomials_confuse_do_not_link(spark):
    # Thue-Morse words and their complements have equal hashes under any polynomial modulo 2^64.
    rows = []
    for bits in (7, 10, 11, 14):
        word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
        rows += [f"x y z {word}", f"x y z {word.translate(str.maketrans('ab', 'ba'))}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join(docs).collect())) == [(i, 1, i) for i in range(len(rows))]


def test_words_of_all_lengths_have_hashes_of_their_own():
    import pyarrow as pa

    words = [c * n for c in ("a", "b", "é", "\x00") for n in [*range(1, 40), 128, 255, 256, 257, 300]] + ["a" * n + "b" for n in range(1, 300)]
    one = [x.tolist() for x in Shingler(4).hashes(pa.array(words))]
    assert len({tuple(x) for x in one}) == len(set(words))
    # A word's hash depends on its own bytes only, and A-Z count as a-z.
    joined = Shingler(1).hashes(pa.array([" ".join(words).upper().replace("É", "é")]))[0]
    apart = {x for w in words for x in Shingler(1).hashes(pa.array([w]))[0].tolist()}
    assert set(joined.tolist()) == apart


def test_few_unconnected_sets_take_no_more_rounds(spark, monkeypatch):
    from motifspark.llm import jaccard_join as module

    rng, texts = random.Random(3), []
    words = [f"w{i}" for i in range(60)]
    for _ in range(60):
        # Copies with edits of one text: neither all of them link nor none.
        texts.append(" ".join(f"v{rng.randrange(99)}" if rng.random() < 0.02 else w for w in words))
    rounds, own, docs = [], module.release, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(module, "release", lambda session: (rounds.append(1), own(session)))
    assert sorted(map(tuple, jaccard_join(docs).collect())) == brute(texts)
    # One before the first round and one after it.
    assert len(rounds) <= 2
    for name in ("MEETINGS", "PAIRS"):
        rounds.clear()
        with monkeypatch.context() as changed:
            changed.setattr(module, name, -1)
            assert sorted(map(tuple, jaccard_join(docs).collect())) == brute(texts)
        assert len(rounds) > 2
