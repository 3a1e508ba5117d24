import duckdb

from tracefold.plans.catalog import load


def test_long_results_of_automations_are_cut_as_in_the_sql(spark, tmp_path):
    rows = [(c, t, r, "line\n" * n) for c in (5, 6, 16) for t, r, n in ((0, "user", 3), (1, "assistant", 900))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    queries, oracles = load()
    found = queries["daily_source_pages"](spark, str(tmp_path)).select("daily_path", "id", "block").collect()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(oracles["daily_source_pages"]).fetchall()
    assert sorted(tuple(r) for r in found) == sorted(want) and any(len(b) < 4000 and "自动化记录" in b for _, _, b in want)
