"""The base columns of operators 2, 5 and 6 equal their SQL on nulls, empty, long and odd texts."""

import duckdb
import pytest

from motifspark.llm import catalog

EIGHT = "one two three four five six seven eight"
TEXTS = [
    None, "", " \n\t ", "cc by cc-by CC BY, all rights  reserved general public\nlicense", "all rights", f"{EIGHT} {EIGHT} {EIGHT}\n# x\n# x\n\n",
    "PassWord = 'abc123' token:x api_key=secret=abcdef", "AKIA" + "A1" * 10 + " " + "0f" * 20 + "é" + "ab" * 12, "Key tokKen=abcdefgh é日本 | <b>", f"{EIGHT}\n" * 300,
]


@pytest.mark.parametrize("name", ["license_phrases", "quality_statistics", "secret_base_spans"])
def test_base_columns_equal_their_sql(spark, tmp_path, name):
    rows = [(i, text) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(wanted.fetchall())
