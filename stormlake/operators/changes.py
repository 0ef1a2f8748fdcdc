"""Change feed between two snapshots of a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows inserted, deleted or updated (before and after), with ``_change_type``.

    Whole rows are compared null-safely, so equal rows give nothing and no hash can
    hide a change.
    """
    columns = new.columns
    before = old.select(F.col(key).alias("_old_key"), F.struct(*columns).alias("_old"))
    after = new.select(F.col(key).alias("_new_key"), F.struct(*columns).alias("_new"))
    both = before.join(after, F.col("_old_key") == F.col("_new_key"), "full_outer")

    def change(kind: str, row: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(row).alias("row"))

    changes = (
        F.when(F.col("_old_key").isNull(), F.array(change("insert", "_new")))
        .when(F.col("_new_key").isNull(), F.array(change("delete", "_old")))
        .otherwise(F.array(change("update_preimage", "_old"), change("update_postimage", "_new")))
    )
    changed = both.where(~F.col("_old").eqNullSafe(F.col("_new")))
    return changed.select(F.explode(changes).alias("change")).select(
        "change.row.*", F.col("change.kind").alias("_change_type")
    )


def apply_changes(old: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The new snapshot from the old one and its change feed."""
    gone = feed.where(F.col("_change_type") != "insert").select(key).distinct()
    fresh = feed.where(F.col("_change_type").isin("insert", "update_postimage"))
    kept = old.join(gone, key, "left_anti").select(*old.columns)
    return kept.unionByName(fresh.drop("_change_type"))
