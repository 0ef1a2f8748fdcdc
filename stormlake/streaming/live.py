"""Live ingest: announcements of the feed met with the payloads that land.

Feed and landing zone are two streams, joined on the link within ``wait`` of each other. Every announced storm
bulletin and every payload comes to exactly one end: met and ingested (or rejected, with its payload), announced
but ``missing``, or landed but ``unannounced``. The latter two are known once the watermark has passed the
time in which the other half could still come, and are kept beside the table; state older than that is let go. A run
takes in all that landed as one batch, so all its payloads pass through the state, which therefore lies on disk.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..session import work_path
from ..sources.bulletins import parse_bulletins
from ..sources.feed import announces_storm
from ..sources.tables import delete_path, list_names

UNMET = "link string, status string, since timestamp, run string"
MISSING, UNANNOUNCED = "missing", "unannounced"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: payloads wait on the executors' disks, with so many MB of an executor's memory for all state; in the heap they would all have to fit
STATE = {
    _PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "128",
    f"{_ROCKS}.writeBufferSizeMB": "8",
    # a commit then writes buffers out: partitions that wait hold none
    f"{_ROCKS}.changelogCheckpointing.enabled": "false",
    # one store for a partition of the join, not four
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def meet(feed: DataFrame, landed: DataFrame, wait: str, late: str) -> DataFrame:
    """``link, body, status, since`` of announcements and payloads; the status is null where both are there.

    ``feed`` holds ``title, link, announced_at`` and ``landed`` holds ``link, body, landed_at``, both streams.
    The two times of a link may lie ``wait`` apart in either direction; rows that come
    more than ``late`` after a newer one may be dropped. All entries, not those of storms alone, move the time on.
    A feed lists its entries again at every poll: repeated ones count once.
    """
    # filtered after repeated ones are dropped: a filter on the title would else move below the watermark
    timed = feed.withColumn("storm", announces_storm(F.col("title"))).withWatermark("announced_at", late)
    once = timed.dropDuplicatesWithinWatermark(["link", "storm"]).where("storm")
    once = once.select(F.col("link").alias("announced"), "announced_at")
    payloads = landed.select("link", "body", "landed_at").withWatermark("landed_at", late)
    span = F.expr(f"INTERVAL {wait}")
    near = F.col("landed_at").between(F.col("announced_at") - span, F.col("announced_at") + span)
    met = once.join(payloads, (F.col("announced") == F.col("link")) & near, "full_outer")
    status = F.when(F.col("link").isNull(), MISSING).when(F.col("announced").isNull(), UNANNOUNCED)
    return met.select(
        F.coalesce("link", "announced").alias("link"), "body", status.alias("status"),
        F.coalesce("announced_at", "landed_at").alias("since"),
    )


def unmet_path(path: str) -> str:
    """Where the announcements and payloads without their other half are kept, beside the table's data."""
    return f"{path}/_unmet"


def read_unmet(spark: SparkSession, path: str) -> DataFrame:
    """``link, status, since, run`` of what did not meet on the way to the table at ``path``."""
    if not list_names(spark, unmet_path(path)):
        return spark.createDataFrame([], UNMET)
    return spark.read.schema(UNMET).parquet(unmet_path(path))


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state as ``STATE`` says, unless the session names a store of its own."""
    made = {} if spark.conf.get(_PROVIDER, None) else {k: v for k, v in STATE.items() if spark.conf.get(k, None) is None}
    for key, value in made.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in made:
            spark.conf.unset(key)


def ingest_announced(
    feed: DataFrame, landed: DataFrame, table: str, checkpoint: str, wait: str = "6 HOURS", late: str = "1 HOUR"
) -> StreamingQuery:
    """Ingest all that was announced and has landed since the last run, then stop; see :func:`meet`.

    A repeated batch replaces its own records and merges to the same table. A checkpoint goes on with the store it began with.
    """
    stream = md5(checkpoint.encode()).hexdigest()[:12]

    def take(batch: DataFrame, number: int) -> None:
        spark, run = batch.sparkSession, f"{stream}-{number:010d}"
        # the batch comes out of state: it is written once, as two outputs read it
        work = work_path(spark, "met")
        batch.write.parquet(work)
        held = spark.read.schema(batch.schema).parquet(work)
        unmet = held.where(F.col("status").isNotNull()).select("link", "status", "since")
        if not unmet.isEmpty():
            unmet.write.mode("overwrite").parquet(f"{unmet_path(table)}/run={run}")
        met = held.where(F.col("status").isNull())
        if not met.isEmpty():
            ingest(spark, parse_bulletins(met), table, newest="Serial", run=run)
        delete_path(spark, work)

    met = meet(feed, landed, wait, late).writeStream.foreachBatch(take)
    with _state_on_disk(feed.sparkSession):
        return met.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
