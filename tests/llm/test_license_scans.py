import random
import re
import textwrap
from fractions import Fraction

from motifspark.llm.license_scans import TEMPLATES, Matcher, license_scan, phrase_starts, words_of


def test_join_equals_brute_force():
    rng = random.Random(9)
    pick = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, n)))
    for _ in range(500):
        templates = [(str(i), " ".join(rng.sample(words := pick(8).split(), rng.randint(0, min(2, len(words))))), " ".join(words)) for i in range(4)] + [("z", "", "a")]
        counts = {w.encode(): rng.randint(0, 5) for w in "abcdefghij"}
        threshold = Fraction(rng.randint(1, 5), 5)
        matcher = Matcher(templates, counts, threshold)
        for _ in range(10):
            block = words_of(pick(12).encode())
            want = {}
            for label, must, text in templates:
                t = set(words_of(text.encode()))
                if t and set(words_of(must.encode())) <= set(block) and len(t & set(block)) >= threshold * len(t):
                    want[label] = len(t & set(block)) / len(t)
            assert matcher.match(block) == want


def test_phrase_starts():
    words = b"cc by x cc by cc by".split()
    assert phrase_starts(words, [b"cc", b"by"]) == [0, 3, 5]
    assert phrase_starts(b"a a a".split(), [b"a", b"a"]) == [0, 1]


def test_rows(spark):
    texts = [(1, "x CC-BY y\nAll rights reserved. cc by"), (2, "so\nLicensed under the Apache license version 2.0"), (3, None), (4, ""), (5, "ccby all rights"), (None, "General Public License")]
    out = {r["doc_id"]: tuple(r)[1:] for r in license_scan(spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, labels int")).collect()}
    assert out[1] == (9, 3, 1, 7, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert out[2] == (9, 0, None, None, "", "apache-2.0", 1.0)
    assert out[3] == out[4] == (0, 0, None, None, "", "", 0.0) and out[5][1] == 0
    assert out[None][4] == "gpl"
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_labels_name_the_licence(spark):
    texts = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "licensed under the GNU General Public License, version 2.0": "gpl",
        "We released the record under the new license": "",
        "Licensed under the MIT license, version 2.0": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "licensed under the Apache terms of another version": "",
    }
    out = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in out} == dict(enumerate(texts.values()))


def test_wrapped_notices(spark):
    comment = lambda text, width: "\n".join(f" * {line}" for line in textwrap.wrap(text, width))
    around = "Some code stands here and more of it\n"
    rows = [(i, around * 3 + comment(t, width) + "\n" + around * 3) for i, (t, width) in enumerate((t, w) for *_, t in TEMPLATES for w in (20, 50, 80))]
    # Words of a template that stand far apart are no notice.
    words = TEMPLATES[4][2].split()
    rows.append((-1, "\n".join(w + " x" * 5 for w in words)))
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out.pop(-1) == ("", 0.0)
    for i, label in enumerate(label for label, *_ in TEMPLATES for _ in range(3)):
        assert label in out[i][0].split(",") and out[i][1] == 1.0


def test_windows_equal_brute_force():
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, n)))
    for _ in range(1000):
        templates, threshold = [(str(i), " ".join(rng.sample(words := pick(8).split(), rng.randint(0, min(2, len(words))))), " ".join(words)) for i in range(4)] + [("z", "", "a")], Fraction(rng.randint(1, 5), 5)
        text, want = words_of(pick(30).encode()), {}
        for label, must, words in templates:
            t = words_of(words.encode())
            span = -(-len(t) * threshold.denominator // threshold.numerator)
            blocks = [set(text[i : i + span]) for i in range(len(text))]
            best = max((len(set(t) & b) for b in blocks if set(words_of(must.encode())) <= b), default=0)
            if t and best and best >= threshold * len(set(t)):
                want[label] = best / len(set(t))
        assert Matcher(templates, {}, threshold).windows(text) == want


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(2)
    pieces = ["cc", "by", "CC-BY", " ", "\n", "general", "Public", "license", "all rights", "reserved", ".", "x", "é", "all", "rights"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += texts[:5] + ["General Public License " * 30_000]
    out = sorted(map(tuple, license_scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()))
    want = []
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = [(j, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for j in range(len(words)) if words[j : j + len(phrase.split())] == phrase.split()]
        starts = [j for j, _ in found]
        want.append((i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))))
    assert out == want
