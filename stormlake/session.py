"""Session settings and the shared work folder."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stormlake", **conf: str) -> SparkSession:
    """A session with adaptive execution; anything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share (``spark.checkpoint.dir``).

    A local master may go without that setting; it then uses a folder in the warehouse.
    The folder is taken as named: a ``file:`` one may well be a mount that all machines share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/stormlake/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Used where several branches of one plan need the same costly input: it is then
    computed once, and a lost executor costs a re-read, not a recomputation. Wide rows
    need ``rows_per_file``: a reader's batch has up to 4096 rows of a file, however wide.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    writer.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
