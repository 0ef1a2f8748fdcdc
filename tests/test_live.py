"""Feed and landing zone as two streams: every half comes to exactly one end."""

from datetime import datetime, timedelta
from pathlib import Path

from bulletin_text import bulletin, name, section
from pyspark.sql import functions as F

from stormlake.constants import FEED_TITLE
from stormlake.plans.ingest import read_rejected
from stormlake.session import work_path
from stormlake.sources.bulletins import stream_payloads
from stormlake.sources.feed import stream_feed
from stormlake.sources.tables import read_documents
from stormlake.streaming.live import ingest_announced, read_unmet

NOON = datetime(2024, 8, 28, 12)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LANDED = "link string, body string, landed_at timestamp"


def report(label):
    return bulletin(section("2024-08-28T13:00:00+09:00", name(label)), event=label)


class Live:
    """A feed folder, a landing folder and the table they go to."""

    def __init__(self, spark):
        self.spark = spark
        self.feed, self.landing, self.table, self.offsets = (work_path(spark, n) for n in ("feed", "landing", "table", "offsets"))

    def run(self, entries, payloads):
        """Entries are ``(hours after noon, link, title)``, payloads ``(hours after noon, link, body)``."""
        at = lambda hours: NOON + timedelta(hours=hours)
        lines = [
            (f'<entry><title>{title}</title><link href="{link}"/><updated>{at(h).isoformat()}Z</updated></entry>',)
            for h, link, title in entries
        ]
        rows = [(link, body, at(h)) for h, link, body in payloads]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.feed)
        self.spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(self.landing)
        payloads = self.spark.readStream.schema(LANDED).parquet(self.landing)
        feed = stream_feed(self.spark, self.feed, per_line=True)
        ingest_announced(feed, payloads, self.table, self.offsets, "2 HOURS", "1 MINUTE").awaitTermination()

    def ends(self):
        found = {(r.link, r.status) for r in read_unmet(self.spark, self.table).collect()}
        found |= {(r.link, r.reason) for r in read_rejected(self.spark, self.table).collect()}
        return found

    def storms(self):
        return sorted(r.EventID for r in read_documents(self.spark, self.table).collect())


def test_met_lost_late_rejected_and_unannounced(spark):
    live = Live(spark)
    live.run(
        [(0, "a", FEED_TITLE), (0, "a", FEED_TITLE), (0, "lost", FEED_TITLE), (0.1, "late", FEED_TITLE), (0.1, "broken", FEED_TITLE), (0.2, "other", "x")],
        [(0.1, "a", report("A")), (0.2, "broken", "<Report><Head>"), (0.2, "other", report("O")), (-0.1, "early", report("E"))],
    )
    assert live.storms() == ["A"] and live.ends() == {("broken", "unparsable")}
    # the announcement of a payload that landed first; nothing is given up before its time
    live.run([(0.5, "early", FEED_TITLE), (1, "a", FEED_TITLE)], [(1, "x", report("X"))])
    assert live.storms() == ["A", "E"] and live.ends() == {("broken", "unparsable")}
    # time goes on by entries that announce no storm
    live.run([(9, "y", "x")], [(5, "late", report("L")), (9, "z", "")])
    assert live.storms() == ["A", "E"]
    ends = live.ends()
    assert {("lost", "missing"), ("late", "missing"), ("other", "unannounced"), ("x", "unannounced"), ("late", "unannounced")} <= ends
    assert not {e for e in ends if e[0] in ("z", "y", "early")}
    # nothing new: nothing changes
    live.run([(9, "y", "x")], [(9, "z", "")])
    assert live.storms() == ["A", "E"] and live.ends() >= ends


def test_sources_give_times(spark):
    folder = work_path(spark, "folder")
    spark.createDataFrame([("<entry><title>t</title><link href='l'/></entry>",)], "value string").write.text(folder)
    for stream, time in ((stream_feed(spark, folder, per_line=True), "announced_at"), (stream_payloads(spark, folder, True), "landed_at")):
        query = stream.writeStream.format("memory").queryName(f"seen_{time}").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.table(f"seen_{time}").collect()
        assert len(rows) == 1 and rows[0][time] is not None


def test_an_empty_start(spark):
    live = Live(spark)
    live.run([], [])
    assert live.ends() == set()


def stored(live):
    """The kinds of files that the state is kept in."""
    found = {x.suffix for x in Path(live.offsets, "state").rglob("[0-9]*") if x.is_file()}
    return found & {".delta", ".zip", ".changelog"}


def test_state_lies_on_disk(spark):
    live = Live(spark)
    live.run([(0, "a", FEED_TITLE)], [(0.1, "a", report("A"))])
    assert live.storms() == ["A"] and stored(live) and ".delta" not in stored(live)
    assert spark.conf.get(PROVIDER, None) is None


def test_a_checkpoint_goes_on_with_its_store(spark):
    live = Live(spark)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        live.run([(0, "a", FEED_TITLE)], [(0.1, "x", report("X"))])
    finally:
        spark.conf.unset(PROVIDER)
    assert stored(live) == {".delta"}
    live.run([(0.2, "x", FEED_TITLE)], [(0.2, "a", report("A"))])
    assert live.storms() == ["A", "X"] and stored(live) == {".delta"}
