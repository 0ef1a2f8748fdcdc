"""Embedding index kept in step with a document table: from two frames, or from the table's changes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import KEY, Table, delete_path, document_table, list_names, read_table, touch
from .dedup import latest
from .embed import DIMENSIONS, embed
from .merge import BATCH, CHANGE, Merged, last_batch, merge, read_changes

INDEX = "unique_event_id string, text_hash string, embedding array<float>, event_year string, event_bucket int"
_MARKS = "_marks"


def index_table(path: str) -> Table:
    """The stored index, laid out like the documents."""
    return Table(path, INDEX, KEY, ("event_year", "event_bucket"), (KEY,))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, index_table(path))


def sync_actions(index: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text_hash, action``: what the index needs to match the documents.

    Only keys and hashes meet in the join; the texts stay behind.
    """
    wanted = documents.select(F.col(key), F.sha2(F.col(text), 256).alias("text_hash"))
    held = index.select(F.col(key), F.col("text_hash").alias("held_hash"))
    both = wanted.join(held, key, "full_outer")
    action = (
        F.when(F.col("held_hash").isNull(), "insert")
        .when(F.col("text_hash").isNull(), "delete")
        .when(F.col("text_hash") == F.col("held_hash"), "keep")
        .otherwise("update")
    )
    return both.select(
        key, F.coalesce("text_hash", "held_hash").alias("text_hash"), action.alias("action")
    )


def sync_index(
    index: DataFrame | None, documents: DataFrame, key: str, text: str, dim: int = DIMENSIONS
) -> DataFrame:
    """The index ``key, text_hash, embedding`` after a sync: unchanged texts keep their
    vector, new and changed ones are embedded, vanished keys go."""
    hashed = documents.select(
        F.col(key), F.col(text), F.sha2(F.col(text), 256).alias("text_hash")
    )
    if index is None:
        kept, stale = None, hashed
    else:
        match = [key, "text_hash"]
        kept = index.join(hashed.select(*match), match, "left_semi")
        stale = hashed.join(index.select(*match), match, "left_anti")
    # key and hash travel together, so the texts are read once
    stale = stale.select(F.struct(key, "text_hash").alias("entry"), text)
    fresh = embed(stale, "entry", text, dim).select("entry.*", "embedding")
    return fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh)


def _entries(documents: DataFrame, dim: int) -> DataFrame:
    """Index rows of documents: key, text hash and place travel together, so texts are read once."""
    entry = F.struct(KEY, F.sha2("Text", 256).alias("text_hash"), "event_year", "event_bucket").alias("entry")
    return embed(documents.select(entry, "Text"), "entry", "Text", dim).select("entry.*", "embedding")


def synced_batch(spark: SparkSession, path: str) -> int | None:
    """The last batch of changes that the index at ``path`` has taken in; null before its first sync."""
    marks = list_names(spark, f"{path}/{_MARKS}")
    return max(map(int, marks), default=None)


def sync_stored_index(spark: SparkSession, documents: str, index: str, dim: int = DIMENSIONS) -> Merged:
    """Bring the index at ``index`` up to the last recorded change of the document table at ``documents``.

    The first sync embeds the whole table. Later ones read the batches of changes since the last mark only,
    embed texts that changed and touch the partitions of those; the documents themselves are not read. The mark
    moves last: a sync that died is done again, and what it had done already is no change then.
    """
    table, stored = document_table(documents), index_table(index)
    mark, newest = synced_batch(spark, index), last_batch(spark, table)
    if mark == newest:
        return Merged(0)
    if mark is None:
        done = merge(spark, stored, _entries(read_table(spark, table), dim))
    else:
        images = read_changes(spark, table, mark + 1, newest).where(F.col(CHANGE) != "update_preimage")
        last = latest(images, (KEY,), F.desc(BATCH))
        written = last.where(F.col(CHANGE) != "delete")
        # the hash before the first of these batches: only another text needs another vector
        before = read_changes(spark, table, mark + 1, newest).where(F.col(CHANGE) == "update_preimage")
        held = latest(before, (KEY,), F.asc(BATCH)).select(KEY, F.sha2("Text", 256).alias("_held"))
        stale = written.join(held, KEY, "left").where(~F.sha2("Text", 256).eqNullSafe(F.col("_held")))
        gone = last.where(F.col(CHANGE) == "delete").select("event_year", "event_bucket", KEY)
        done = merge(spark, stored, _entries(stale, dim), removed=gone)
    touch(spark, f"{index}/{_MARKS}/{newest}")
    if mark is not None:
        delete_path(spark, f"{index}/{_MARKS}/{mark}")
    return done
