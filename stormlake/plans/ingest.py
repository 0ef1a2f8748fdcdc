"""Bulletins to documents to the published table."""

from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest_observations
from ..operators.documents import document_rows
from ..operators.extract import observation_rows
from ..operators.upsert import upsert
from ..schemas import CORRUPT
from ..session import work_path
from ..sources.bulletins import REASONS, judge_bulletins, parse_bulletins, split_judged, split_quarantine
from ..sources.feed import storm_entries
from ..sources.tables import delete_path, list_names


def observations(parsed: DataFrame) -> DataFrame:
    """Latest observation rows of parsed bulletins; rejected bulletins are left out."""
    good, _ = split_quarantine(parsed)
    return latest_observations(observation_rows(good))


def documents(parsed: DataFrame) -> DataFrame:
    return document_rows(observations(parsed))


def documents_from_payloads(landed: DataFrame) -> DataFrame:
    """Documents of ``(link, body)`` rows."""
    return documents(parse_bulletins(landed))


def announced(feed: DataFrame, landed: DataFrame) -> DataFrame:
    """The ``(link, body)`` rows that the feed announces as storm bulletins."""
    links = storm_entries(feed).select("link").distinct()
    return landed.join(links, "link", "left_semi")


REJECTED = "link string, file_name string, reason string, payload string, run string"


def rejected_path(path: str) -> str:
    """Where the rejected bulletins of the table at ``path`` are kept, beside its data."""
    return f"{path}/_rejected"


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """``link, file_name, reason, payload, run`` of all that was rejected on the way to the table at ``path``."""
    if not list_names(spark, rejected_path(path)):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(rejected_path(path))


def ingest(
    spark: SparkSession, parsed: DataFrame, path: str, newest: str | None = "Serial", run: str | None = None
) -> dict[str, int]:
    """Upsert the documents of parsed bulletins into the table at ``path``; how many were good and rejected, by reason.

    Every payload is parsed and judged once, into a written table; the good ones go on to the documents, the
    others are kept with reason and payload, so that both together are all that landed. They
    lie below the name of the ``run``: a run of the same name, such as a batch of a
    stream that is repeated, replaces its own. A stored bulletin of a higher serial stays, as in the
    stream; ``newest=None`` lets the source win.
    """
    run = run or f"run-{uuid4().hex}"
    seen = Observation("ingest")
    reason = F.col("reason")
    counts = [F.count(F.when(reason == r, 1)).alias(r) for r in REASONS]
    judged = judge_bulletins(parsed).withColumn("payload", F.when(reason.isNotNull(), F.col("payload"))).drop(CORRUPT)
    work = work_path(spark, "judged")
    observed = judged.observe(seen, F.count(F.when(reason.isNull(), 1)).alias("ok"), *counts)
    observed.write.parquet(work)
    held = spark.read.schema(judged.schema).parquet(work)
    good, bad = split_judged(held)
    found = {name: int(n) for name, n in seen.get.items()}
    if sum(found.values()) > found["ok"]:
        bad.write.mode("overwrite").parquet(f"{rejected_path(path)}/run={run}")
    upsert(spark, document_rows(latest_observations(observation_rows(good))), path, newest)
    delete_path(spark, work)
    return found
