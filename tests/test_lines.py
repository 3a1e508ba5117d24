import duckdb

from tracefold.plans.catalog import load


def test_first_matching_lines_keep_digits_and_lose_every_space_separator(spark, tmp_path):
    texts = ["7 a\n1 b\n2 c2\nx 3", "\u00a0a1\u3000\n\tb2\t", "", None, "\n".join(f" {i} line {i}" for i in range(30)), "a1\r\na1\n a1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    queries, oracles = load()
    got = sorted((r.doc_id, r.shown, r.first) for r in queries["first_matching_lines"](spark, str(tmp_path)).select("doc_id", "shown", "first").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(oracles["first_matching_lines"]).fetchall())
