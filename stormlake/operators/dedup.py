"""Latest row per key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION_KEY = ("EventID", "ObservationTime")


def latest(rows: DataFrame, key: tuple[str, ...], *newest_first: Column) -> DataFrame:
    """One row per key, the first in the given order.

    Ranking with a limit of one is pruned before the shuffle (``WindowGroupLimit``), so
    a key repeated over many rows sends one row per input task, not all of them.
    """
    order = Window.partitionBy(*key).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_observations(rows: DataFrame) -> DataFrame:
    """Latest bulletin per event and time: highest serial, then file name.

    The remaining order makes the choice definite when one bulletin reports a time twice.
    """
    serial = F.col("Serial").try_cast("bigint")
    rest = [c for c in rows.columns if c not in (*OBSERVATION_KEY, "Serial", "file_name")]
    return latest(
        rows,
        OBSERVATION_KEY,
        serial.desc_nulls_last(),
        F.col("file_name").desc_nulls_last(),
        F.xxhash64(*rest).desc(),
    )
