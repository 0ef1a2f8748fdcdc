"""Continuous ingest of landed bulletins."""

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..sources.bulletins import stream_bulletins


def ingest_landed(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    per_line: bool = False,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Upsert everything that landed since the last run, then stop.

    A repeated batch merges to the same table, and a late bulletin never replaces one of
    a higher serial, so neither a restart nor the order of arrival changes the result. Rejected
    bulletins are kept by batch; a repeated batch replaces its own.
    """
    stream = md5(checkpoint.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, number: int) -> None:
        ingest(batch.sparkSession, batch, table, newest="Serial", run=f"{stream}-{number:010d}")

    bulletins = stream_bulletins(spark, landing, per_line, files_per_trigger)
    return (
        bulletins.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
