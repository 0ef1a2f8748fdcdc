"""Bulletin scans: a folder of XML files, or payloads already held in a column."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import OBSERVED
from ..functions.text import blank_to_null, link_filename
from ..schemas import BULLETIN, CORRUPT
from .folders import read_files

XML_OPTIONS = {
    "rowTag": "Report",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
}


#: the columns of the binary file source
_FILE = "path string, modificationTime timestamp, length bigint, content binary"

#: why a bulletin may be rejected
REASONS = ("unparsable", "no event id", "no sections", "section without time")


def _whole() -> Column:
    return F.make_valid_utf8(F.col("content").cast("string"))


def _unmarked(body: Column) -> Column:
    return F.regexp_replace(body, "^\ufeff", "")


def _payloads(reader, path: str, per_line: bool) -> DataFrame:
    """``link, body``: the payloads of a folder; a bulletin's path is its link.

    Whole files are read as they are: the source packs many small ones into a task by their size.
    """
    if per_line:
        body, rows = F.col("value"), reader.format("text").load(path).where(F.trim("value") != "")
    else:
        files = reader.format("binaryFile").schema(_FILE).load(path)
        body, rows = _whole(), files
    return rows.select(
        F.col("_metadata.file_path").alias("link"), _unmarked(body).alias("body"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )


def read_payloads(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``link, body`` of every bulletin below ``path``, in UTF-8.

    A file is one XML document of any number of lines. With ``per_line`` every line of a file is a bulletin of
    its own: such packed files are split between tasks, and a broken line spoils no other. Whole files on a
    mounted file system are listed and read by the tasks, those of other stores by Spark's source, which lists on the driver.
    """
    files = None if per_line else read_files(spark, path)
    if files is not None:
        return files.select("link", _unmarked(_whole()).alias("body"))
    return _payloads(spark.read, path, per_line).drop("landed_at")


def stream_payloads(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Newly landed payloads as a stream of ``link, body, landed_at``; a payload landed when its file was written."""
    return _payloads(spark.readStream, path, per_line)


def read_bulletins(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """The parsed bulletins below ``path``, each with its payload."""
    return parse_bulletins(read_payloads(spark, path, per_line))


def stream_bulletins(
    spark: SparkSession, path: str, per_line: bool = False, files_per_trigger: int | None = None
) -> DataFrame:
    """Newly landed bulletins as a stream, in the same shape as :func:`read_bulletins`."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_bulletins(_payloads(reader, path, per_line))


def parse_bulletins(df: DataFrame, body: str = "body", link: str = "link") -> DataFrame:
    """Parse payloads held in column ``body``; they stay in the rows as ``payload``.

    ``inline`` makes the parse a generator: predicates on the parsed fields stay above
    it, so every payload is parsed once.
    """
    report = F.from_xml(F.col(body), BULLETIN, XML_OPTIONS)
    return df.select(
        F.col(link).alias("link"),
        link_filename(F.col(link)).alias("file_name"),
        F.col(body).alias("payload"),
        F.inline(F.array(report)),
    )


def _bad_reason() -> Column:
    sections = F.col("Body.MeteorologicalInfos.MeteorologicalInfo")
    timeless = F.exists(
        sections,
        lambda s: s["DateTime"]["_type"].isNull()
        | ((s["DateTime"]["_type"] == OBSERVED) & blank_to_null(s["DateTime"]["_VALUE"]).isNull()),
    )
    return (
        F.when(F.col(CORRUPT).isNotNull(), F.lit(REASONS[0]))
        .when(blank_to_null(F.col("Head.EventID")).isNull(), F.lit(REASONS[1]))
        .when(sections.isNull(), F.lit(REASONS[2]))
        .when(timeless, F.lit(REASONS[3]))
    )


def judge_bulletins(df: DataFrame) -> DataFrame:
    """Add ``reason``: why a bulletin cannot be used, null for a good one.

    A bulletin without a key must not pass: a null key never matches an upsert.
    """
    return df.withColumn("reason", _bad_reason())


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable bulletins, and rejected ones as ``link, file_name, reason, payload``."""
    good = judged.where(F.col("reason").isNull()).drop("reason", CORRUPT)
    return good, judged.where(F.col("reason").isNotNull()).select("link", "file_name", "reason", "payload")


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed bulletins into usable and rejected ones; the latter with reason and payload."""
    return split_judged(judge_bulletins(df))
