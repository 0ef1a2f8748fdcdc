"""The plans that matter at scale."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stormlake import fixtures as fx
from stormlake.operators.dedup import latest_observations
from stormlake.operators.extract import observation_rows
from stormlake.operators.questions import resolve_questions
from stormlake.operators.retrieve import match_questions, retrieve
from stormlake.plans.ingest import documents
from stormlake.session import work_path
from stormlake.sources.bulletins import parse_bulletins, split_quarantine
from stormlake.sources.tables import read_documents, write_documents

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.fixture(scope="module")
def table(spark):
    path = work_path(spark, "plan-test")
    write_documents(documents(parse_bulletins(fx.bulletins(fx.table(spark, SF, "events")))), path)
    return read_documents(spark, path)


def test_every_payload_is_parsed_once_and_copies_are_dropped_before_the_shuffle(spark):
    good, _ = split_quarantine(parse_bulletins(fx.bulletins(fx.table(spark, SF, "events"))))
    text = plan(latest_observations(observation_rows(good)))
    assert len(re.findall(r"from_xml\(", text)) == 1
    tree = text.split("(1)")[0]
    assert tree.count("WindowGroupLimit") == 2
    assert tree.rindex("WindowGroupLimit") > tree.index("Exchange")


def test_single_question_prunes_partitions_rows_and_columns(table):
    text = plan(retrieve(table, "Kong Rey", datetime(2024, 1, 5), datetime(2024, 1, 12)).select("Text"))
    assert "PartitionFilters: [isnotnull(event_year" in text
    assert "GreaterThanOrEqual(obs_jst" in text and "LessThanOrEqual(obs_jst" in text
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"TyphoonName", "Text", "obs_jst"}
    assert "Exchange" not in text


def test_batch_has_no_cross_join_and_reads_the_years_asked_for(spark, table):
    questions = spark.createDataFrame([(1, "q", "Trami, 2024-01-05")], "question_id long, question string, parsed string")
    bounded, _ = resolve_questions(questions)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # as if the table were too large to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        text = plan(match_questions(bounded, table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "dynamicpruning" in text


def test_a_month_and_a_year_take_the_same_plan_with_pruned_years(spark, table):
    shapes = []
    for parsed in ("Trami, 2024-01-05, 2024-02-05", "Trami, 2024-01-05, 2024-02-06", "Trami, None, 2024-02-06"):
        questions = spark.createDataFrame([(1, "q", parsed)], "question_id long, question string, parsed string")
        bounded, _ = resolve_questions(questions)
        text = plan(match_questions(bounded, table))
        assert "dynamicpruning" in text
        shapes.append(re.findall(r"^[ :+*-]*\(?\d*\)? ?(\w+)", text.split("(1)")[0], re.M))
    assert shapes[0] == shapes[1] == shapes[2]
