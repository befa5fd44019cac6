import random

from pyspark.sql import functions as F

from motifspark.llm.common import lookup
from motifspark.llm.url_filters import url_filter

SCHEMA = "page_id long, url string, host int"


def test_rules_nulls_and_clashing_columns(spark):
    urls = {1: "http://A.Example.com/en/x", 2: "https://www.example.com/en/?q", 3: "http://b.net/es/1", 4: "http://xcom/en/", 5: None, 6: "nothing", 7: "http://com", 8: "http://www.example.com/EN/#a"}
    out = {r["page_id"]: tuple(r)[1:] for r in url_filter(spark.createDataFrame([(i, u, 0) for i, u in urls.items()], SCHEMA)).collect()}
    assert out[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[3][2:] == ("net/es/", "block")
    assert out[4] == ("xcom", "/en/", None, "allow")
    assert out[5][:3] == out[6][:3] == ("", "", None)
    assert out[7][:3] == ("com", "", None) and out[8][2:] == ("com/", "allow")
    assert url_filter(spark.createDataFrame([], SCHEMA)).count() == 0


def test_outcomes_of_a_host_decide(spark):
    rows = [(i, f"http://h{i % 3}.site.org/p", int(i % 3 == 0)) for i in range(300)] + [(1000 + i, f"http://h{i}.site.org/q", None) for i in range(3)]
    out = url_filter(spark.createDataFrame(rows, "page_id long, url string, bad int"), outcome=F.col("bad") == 1)
    assert {r["page_id"]: r["verdict"] for r in out.where("page_id >= 1000").collect()} == {1000: "block", 1001: "allow", 1002: "allow"}


def test_lookup_of_hot_and_rare_keys(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot", f"k{rng.randrange(4000)}", None]) for _ in range(6000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    found = {r["i"]: r["n"] for r in lookup(rows, groups.where("k <> 'k1'"), "k", "n", 6000).collect()}
    assert found == {i: None if k in (None, "k1") else keys.count(k) for i, k in enumerate(keys)}
