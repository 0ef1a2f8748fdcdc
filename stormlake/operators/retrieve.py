"""Structured retrieval: storm name and time window, for one question or a table of them."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_matches, normal_name, without_hyphen, without_spaces
from ..functions.times import NO_YEAR
from ..session import stage
from .questions import storm_names

RESULT = ("ObservationDate", "ObservationTime", "ObservationDateTime", "Text", "TyphoonName")
_GRAM = 3


def _projection() -> list[Column]:
    """The published columns; the date-time is Tokyo wall clock."""
    return [
        F.col("obs_jst").alias(c) if c == "ObservationDateTime" else F.col(c) for c in RESULT
    ]


def retrieve(
    documents: DataFrame,
    name: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Documents of one question.

    Start and end: closed interval. Start at midnight alone: that day. Another start
    alone: that instant. End alone: up to it. Neither: the name decides. The time window
    is a plain range on a stored column and on the partition column, so files are pruned.
    """
    lo, hi = start, end
    if start and not end:
        midnight = start.time() == datetime.min.time()
        hi = start + timedelta(days=1, microseconds=-1) if midnight else start
    kept = documents
    # an event's year is of its own zone, less than two days from Tokyo time
    margin = timedelta(days=2)
    if lo:
        kept = kept.where(F.col("obs_jst") >= F.lit(lo.isoformat()).cast("timestamp_ntz"))
        if lo > datetime.min + margin:
            kept = kept.where(F.col("event_year") >= f"{(lo - margin).year:04d}")
    if hi:
        kept = kept.where(F.col("obs_jst") <= F.lit(hi.isoformat()).cast("timestamp_ntz"))
        if hi < datetime.max - margin:
            kept = kept.where(F.col("event_year") <= f"{(hi + margin).year:04d}")
    matches = name_matches(F.col("TyphoonName"), normal_name(F.lit(name)))
    return kept.where(matches).select(*_projection())


def _name_grams(text: Column) -> Column:
    """The empty text and every run of one to three characters."""
    positions = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    runs = F.transform(
        positions, lambda p: F.array(*[text.substr(p, F.lit(n)) for n in range(1, _GRAM + 1)])
    )
    return F.concat(F.array(F.lit("")), F.flatten(runs))


def spelled_grams(name: Column) -> Column:
    """The runs of a storm name's characters, with and without its hyphens, that a wanted name may begin with."""
    return F.array_distinct(F.concat(_name_grams(name), _name_grams(without_hyphen(name))))


def match_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """``name, TyphoonName`` for every storm name a wanted name matches.

    Both sides are distinct names. A wanted name can only occur in a storm name that
    holds its first three characters, so the two meet on those and the match itself is
    checked on the survivors. Stored names (``read_names``) bring their ``grams`` with them.
    """
    grams = F.col("grams") if "grams" in names.columns else spelled_grams(F.col("TyphoonName"))
    indexed = names.select("TyphoonName", F.explode(grams).alias("gram"))
    probes = wanted.select("name").distinct().select(
        "name",
        F.explode(
            F.array_distinct(
                F.array(
                    F.substring("name", 1, _GRAM),
                    F.substring(without_spaces(F.col("name")), 1, _GRAM),
                )
            )
        ).alias("gram"),
    )
    met = probes.join(indexed, "gram").where(name_matches(F.col("TyphoonName"), F.col("name")))
    return met.select("name", "TyphoonName").distinct()


def _year(time: Column, days: int) -> Column:
    return F.year(F.date_add(time.cast("date"), days))


def covered_years(documents: DataFrame, lo: Column, hi: Column) -> Column:
    """The years that a window covers, of those that the table has; a null side is open.

    A window without bounds also takes documents of no readable year.
    """
    # the partition column alone: first and last readable year of the table
    held = documents.where(F.col("event_year") != NO_YEAR).select(F.col("event_year").try_cast("int").alias("y"))
    span = held.agg(F.min("y").alias("first"), F.max("y").alias("last")).first()
    first, last = (span["first"], span["last"]) if span["first"] is not None else (1, 0)
    # an event's year is of its own zone, less than two days from Tokyo time
    begin = F.greatest(F.coalesce(_year(lo, -2), F.lit(first)), F.lit(first))
    end = F.least(F.coalesce(_year(hi, 2), F.lit(last)), F.lit(last))
    covered = F.transform(F.sequence(begin, end), lambda y: F.lpad(y.cast("string"), 4, "0"))
    years = F.when(begin <= end, covered).otherwise(F.array().cast("array<string>"))
    return F.when(lo.isNull() & hi.isNull(), F.concat(years, F.array(F.lit(NO_YEAR)))).otherwise(years)


def match_questions(bounded: DataFrame, documents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All documents of all questions: ``question_id, mode`` and the document columns.

    ``bounded`` holds ``question_id, name, mode, lo, hi``. Names are resolved on distinct
    names; a caller that has them at hand spares a scan of the documents. Every window becomes the years it covers, of those that the table has: documents are
    met on name and year, with the window as a filter of the join, so years are pruned at run time for
    short, long and open windows alike. A question without a window also meets documents of no readable year.
    The resolved questions are written out first: their size is then known to the
    planner, which broadcasts them only if they are small and else shuffles both sides.
    """
    asked = bounded.select("question_id", "name", "mode", "lo", "hi")
    resolved = asked.join(match_names(asked, names if names is not None else storm_names(documents)), "name").drop("name")
    named = stage(resolved, "resolved")
    years = covered_years(documents, F.col("lo"), F.col("hi"))
    # the planner prunes years at run time for a side that has a filter of its own
    keyed = named.where(F.size(years) > 0).withColumn("event_year", F.explode(years))
    within = (F.col("lo").isNull() | (F.col("obs_jst") >= F.col("lo"))) & (
        F.col("hi").isNull() | (F.col("obs_jst") <= F.col("hi"))
    )
    met = documents.join(keyed, ["TyphoonName", "event_year"]).where(within)
    return met.select("question_id", "mode", *documents.columns)


def retrieve_batch(bounded: DataFrame, documents: DataFrame) -> DataFrame:
    """The published retrieval columns for a table of questions."""
    return match_questions(bounded, documents).select("question_id", "mode", *_projection())
