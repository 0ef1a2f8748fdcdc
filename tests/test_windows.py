"""Shared windows against the plain way, which repeats every text for every question."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stormlake import fixtures as fx
from stormlake.functions.times import NO_YEAR
from stormlake.operators import windows
from stormlake.operators.context import assemble_context
from stormlake.operators.questions import resolve_questions, storm_names
from stormlake.operators.windows import window_contexts
from stormlake.plans.answer import structured_hits
from stormlake.plans.ingest import documents
from stormlake.session import work_path
from stormlake.sources.bulletins import parse_bulletins
from stormlake.sources.tables import read_documents, write_documents

from tests.test_plans import SF, plan

DOCUMENT = "id_ string, TyphoonName string, Text string, text_chars int, obs_jst timestamp_ntz, event_year string"
QUESTION = "question_id int, name string, mode string, lo timestamp_ntz, hi timestamp_ntz"
START = datetime(2023, 12, 30)


def documents_of(spark, seed, n=150):
    """Few storms, many equal times, a storm without readable times, texts of one to forty characters."""
    rng, rows = random.Random(seed), []
    for number in range(n):
        time = START + timedelta(hours=rng.choice([0, 6, 6, 12, 23, 24, 30, 48, 800]))
        text = f"{number}:" + "x" * rng.randrange(40)
        unread = rng.random() < 0.1
        rows.append((
            f"{number:04d}", rng.choice(["KONG-REY", "KONG-REY", "TRAMI", "O'HARE", None]), text, len(text),
            None if unread else time, NO_YEAR if unread else f"{time.year}",
        ))
    return spark.createDataFrame(rows, DOCUMENT)


def questions_of(spark, seed, n=40):
    rng, rows = random.Random(seed), []
    for number in range(n):
        lo = START + timedelta(hours=rng.randrange(-30, 60)) if rng.random() < 0.7 else None
        hi = (lo or START) + timedelta(hours=rng.choice([0, 1, 20, 24, 900, -5])) if rng.random() < 0.7 else None
        rows.append((number, rng.choice(["KONG REY", "KONGREY", "TRAMI", "", "NOPE", "O HARE"]), "range", lo, hi))
    return spark.createDataFrame(rows, QUESTION)


def rows_of(parts):
    return sorted((r.question_id, r.part, r.context) for r in parts.collect())


@pytest.mark.parametrize("seed, slice_chars", [(1, 4_000_000), (2, 60), (3, 7), (4, 1)])
def test_shared_windows_equal_a_context_per_question(spark, seed, slice_chars):
    docs, bounded = documents_of(spark, seed), questions_of(spark, seed)
    plain = rows_of(assemble_context(structured_hits(bounded, docs), slice_chars))
    assert rows_of(window_contexts(bounded, docs, slice_chars=slice_chars)) == plain
    assert len({q for q, _, _ in plain}) > 15


def test_nothing_to_find(spark):
    docs, bounded = documents_of(spark, 5), questions_of(spark, 5)
    assert rows_of(window_contexts(bounded.limit(0), docs)) == []
    assert rows_of(window_contexts(bounded, docs.limit(0))) == []


def test_a_text_lies_in_one_piece_however_many_windows_hold_it(spark):
    docs = documents_of(spark, 6)
    bounded = spark.createDataFrame(
        [(n, "KONG REY", "range", START + timedelta(minutes=n), START + timedelta(hours=30)) for n in range(200)], QUESTION
    )
    circles, members = windows._circles(bounded, storm_names(docs))
    named = bounded.join(circles, "name")
    moments = windows._moments(named, members, docs)
    days = windows._day_windows(named, moments)
    views = windows._views(days, windows._along(moments, days))
    held, runs = windows._pieces(windows._along(moments, days), windows._slices(views, 4_000_000))
    assert held.count() == held.select("id_").distinct().count()
    # later starts move on by whole instants only: windows that hold the same documents are put together once
    assert views.select("circle", "day", "begin", "end").distinct().count() < 10
    assert runs.groupBy("circle", "day", "begin", "end", "slice", "piece").count().where("count > 1").count() == 0


def test_documents_are_scanned_twice_and_texts_once(spark, monkeypatch):
    path = work_path(spark, "windows-test")
    write_documents(documents(parse_bulletins(fx.bulletins(fx.table(spark, SF, "events")))), path)
    docs = read_documents(spark, path)
    names = spark.createDataFrame([("TRAMI",), ("KONG-REY",)], "TyphoonName string")
    asked = [(1, "q", "Trami, 2024-01-05, 2024-01-09"), (2, "q", "Trami, 2024-01-06"), (3, "q", "Kong Rey, None")]
    bounded, _ = resolve_questions(spark.createDataFrame(asked, "question_id long, question string, parsed string"))
    plans, staged = [], windows.stage

    def noted(df, *rest):
        plans.append(plan(df))
        return staged(df, *rest)

    monkeypatch.setattr(windows, "stage", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plans.append(plan(window_contexts(bounded, docs, names)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    folder = path.rsplit("/", 1)[-1]
    # subtrees that prune at run time repeat no scan of the documents
    scans = [b for text in plans for b in re.split(r"\n\n+", text) if folder in b and "ReadSchema" in b]
    assert len(scans) == 2
    assert [("Text:" in s) for s in scans] == [False, True]
    assert all("dynamicpruning" in s for s in scans)
    assert not any("NestedLoop" in text or "Cartesian" in text for text in plans)
