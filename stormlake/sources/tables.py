"""Published tables as Parquet folders, partitioned by event year and a bucket of the event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT

KEY = "unique_event_id"
#: events of one year are spread over so many folders, so that a correction rewrites one of them
EVENT_BUCKETS = 8


@dataclass(frozen=True)
class Table:
    """Where a table lies, its columns as DDL, its key, and how its rows are laid out."""

    path: str
    schema: str
    key: str
    partition: tuple[str, ...]
    order: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [field.split()[0] for field in self.schema.split(", ")]

    def exists(self, spark: SparkSession) -> bool:
        """Whether rows were ever published; work and changes of a merge alone are no table."""
        return any(not name.startswith(("_", ".")) for name in list_names(spark, self.path))


def document_table(path: str) -> Table:
    return Table(path, DOCUMENT, KEY, ("event_year", "event_bucket"), ("TyphoonName", "obs_jst"))


def event_bucket(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(EVENT_BUCKETS)).cast("int")


def read_table(spark: SparkSession, table: Table) -> DataFrame:
    return spark.read.schema(table.schema).parquet(table.path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, document_table(path))


def layout(df: DataFrame, partition: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Files of even size inside each partition, rows sorted within a file.

    The rebalance hint lets adaptive execution split a partition that holds most of the
    rows and pack small ones; the sort gives row groups tight min/max ranges.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition]).sortWithinPartitions(*partition, *order)


def write_table(rows: DataFrame, table: Table, mode: str) -> None:
    """Write whole partitions; ``overwrite`` replaces only the partitions present in the rows."""
    (
        layout(rows.select(*table.columns), table.partition, table.order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*table.partition)
        .parquet(table.path)
    )


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_table(documents, document_table(path), mode)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it does not exist."""
    system, folder = _hadoop(spark, path)
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def find_folders(spark: SparkSession, path: str) -> list[str] | None:
    """The plain paths of the folders that ``path`` names, which may be a pattern; None unless all are folders of mounted file systems."""
    system, pattern = _hadoop(spark, path)
    found = system.globStatus(pattern) if system.getUri().getScheme() == "file" else None
    if not found or not all(status.isDirectory() for status in found):
        return None
    return [status.getPath().toUri().getPath() for status in found]


def touch(spark: SparkSession, path: str) -> None:
    system, file = _hadoop(spark, path)
    system.create(file, True).close()


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _hadoop(spark, path)
    system.delete(target, True)
