import random
import re
from collections import defaultdict

from motifspark.llm.quality_rules import judge


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, seen, dup, hit = defaultdict(list), set(), 0, set()
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    for found in places.values():
        if len(found) > 1:
            hit |= {p + j for p in found for j in range(8)}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["a", "bé", "#", "日本", " ", "&x"]
    texts = ["".join(rng.choice(bits[: rng.randint(1, 6)]) + rng.choice([" ", "\n", "\t ", " ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " \n", "w " * 5000, "x"]
    rows = judge(spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")).collect()
    for r in rows:
        want = brute(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(200)]
    junk = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(20)] + [" ".join(word() + "%%%" for _ in range(60)) for _ in range(20)]
    rows = judge(spark.createDataFrame([*enumerate(clean + junk)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == set(range(200))
