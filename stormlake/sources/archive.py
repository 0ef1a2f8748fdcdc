"""Raw bulletin archive: payloads as they arrived, below year and event."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import OBSERVED
from ..functions.text import blank_to_null
from ..functions.times import event_year
from .bulletins import parse_bulletins, split_quarantine

ARCHIVE = "file_name string, link string, body string, event_year string, EventID string"


def archive_rows(landed: DataFrame) -> DataFrame:
    """``(link, body)`` rows with the year and event they are filed under.

    A bulletin is filed once per year its observed sections fall in; rejected ones are kept by the ingest.
    """
    good, _ = split_quarantine(parse_bulletins(landed))
    sections = F.col("Body.MeteorologicalInfos.MeteorologicalInfo")
    observed = F.filter(sections, lambda s: s["DateTime"]["_type"] == OBSERVED)
    years = F.array_distinct(F.transform(observed, lambda s: event_year(s["DateTime"]["_VALUE"])))
    return good.select(
        "file_name",
        "link",
        F.col("payload").alias("body"),
        F.explode(years).alias("event_year"),
        blank_to_null(F.col("Head.EventID")).alias("EventID"),
    )


def write_archive(landed: DataFrame, path: str) -> None:
    """Append the payloads; one event may fill many files, never one task.

    The file committer publishes a job's files only when the whole job succeeds, so a
    lost executor leaves no part of it behind.
    """
    rows = archive_rows(landed)
    (
        rows.hint("rebalance", F.col("event_year"), F.col("EventID"))
        .write.mode("append")
        .partitionBy("event_year", "EventID")
        .parquet(path)
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(path)
