"""Rows ahead of work on texts are dealt evenly, and JSON is parsed once a row."""

from tracefold.operators.common import spread
from tracefold.sources.captures import parse_producer_lines
from tracefold.sources.ledger_files import parse_run_history


def test_rows_of_one_task_are_dealt_evenly(spark):
    sizes = spread(spark.range(3200).coalesce(1)).rdd.glom().map(len).collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and sum(sizes) == 3200
    assert max(sizes) <= 2 * 3200 / len(sizes)


def test_queries_over_texts_spread_them(spark, tmp_path):
    from tracefold.plans.catalog.conversations import _meaningful_prompt_text
    from tracefold.plans.catalog.documents import _result_summary

    spark.range(200).selectExpr("id AS doc_id", "'text' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for query in (_meaningful_prompt_text, _result_summary):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_run_files_are_parsed_once(spark):
    runs, _ = parse_run_history(spark.createDataFrame([("h/1", "{}")], "path string, value string"))
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(value") + plan.count("parse_json(value") <= 1


def test_producer_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}", "f", 1)], "value string, source_path string, source_line int")
    kept = parse_producer_lines(lines).where("type = 'session_meta' and turn_id is not null")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("parseJson(value") == 1
