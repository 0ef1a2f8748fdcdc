"""What must not grow with the tables: broadcasts, files written at length, memory of a task."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import queries
from stormlake import fixtures as fx
from stormlake.session import stage

NOON = datetime(2024, 8, 28, 12)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def events(spark, ids):
    rows = [(i, NOON + timedelta(minutes=i or 0), 7, "view") for i in ids]
    return stage(spark.createDataFrame(rows, EVENTS), "events")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_landings_meet_their_times_without_a_broadcast(spark):
    landed = fx.landings(events(spark, [1, 2, 2, 17, 19, None]))
    assert "Broadcast" not in plan(landed)
    found = sorted((r.link.rsplit("/")[-1], r.landed_at) for r in landed.collect())
    ten, late = timedelta(minutes=10), timedelta(hours=5)
    at = lambda i, wait: (f"{i}_0_storm.xml", NOON + timedelta(minutes=i) + wait)
    # a repeated event lands as often as its times meet, a seventeenth never
    assert found == sorted([at(1, ten), *[at(2, ten)] * 4, at(19, late)])


@pytest.fixture
def tables(spark, tmp_path):
    events(spark, range(1, 400)).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["bulletin_scan", "bulletin_stream"])
def test_packed_bulletins_land_compressed_in_bounded_files(spark, tables, monkeypatch, name):
    paths = {}
    work_path = queries.work_path
    monkeypatch.setattr(queries, "work_path", lambda spark, of: paths.setdefault(of, work_path(spark, of)))
    monkeypatch.setattr(queries, "_PER_FILE", 20, raising=False)
    queries.all_queries()[name](spark, tables).collect()
    bodies = spark.read.text(paths["landing"]).where("value <> ''")
    assert bodies.count() == 399
    assert max(r["count"] for r in bodies.groupBy(F.input_file_name()).count().collect()) <= 20
    files = spark.read.format("binaryFile").load(paths["landing"]).agg(F.sum("length")).first()[0]
    assert 2 * files < bodies.agg(F.sum(F.octet_length("value"))).first()[0]


def joined(plan):
    """The names of the columns that go into the joins of a plan, one set for each side."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.nodeName() == "Join":
        yield from ({c.output().apply(i).name() for i in range(c.output().size())} for c in children)
    for child in children:
        yield from joined(child)


def test_rejected_payloads_are_compared_by_digest(spark, tables):
    found = queries.all_queries()["ingest_quarantine"](spark, tables)
    sides = list(joined(found._jdf.queryExecution().optimizedPlan()))
    assert len(sides) == 2 and not {"payload", "body"} & set().union(*sides)
    rejected = [r for r in found.collect() if r.file_name]
    assert len(rejected) == 17 and all(r.whole for r in rejected)
