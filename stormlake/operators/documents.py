"""Observations to documents: rendered text, keys and the published columns."""

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DOCUMENT_LINES, MISSING, MISSING_BY_FIELD
from ..functions.text import blank_to_null
from ..functions.times import event_year, observation_date, observation_time, tokyo_time
from ..sources.tables import event_bucket


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{field}`` places as one concatenation of columns."""
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(values[field])
    return F.concat(*pieces)


def document_text() -> Column:
    """The labelled text of an observation, missing values spelled out."""
    fields = {f for line in DOCUMENT_LINES for _, f, _, _ in Formatter().parse(line) if f}
    values = {
        f: F.coalesce(blank_to_null(F.col(f)), F.lit(MISSING_BY_FIELD.get(f, MISSING)))
        for f in fields
    }
    return fill("\n".join(DOCUMENT_LINES), values)


def unique_event_id() -> Column:
    return F.concat(F.col("EventID"), F.col("ObservationTime"))


def document_rows(observations: DataFrame) -> DataFrame:
    """One document per observation row (text fields, before typing)."""
    time = F.col("ObservationTime")
    rendered = observations.withColumns({"Text": document_text(), "_key": unique_event_id()})
    return rendered.select(
        F.sha2("_key", 256).alias("id_"),
        "EventID",
        "TyphoonName",
        observation_date(time).alias("ObservationDate"),
        observation_time(time).alias("ObservationTime"),
        time.alias("ObservationDateTime"),
        "InfoType",
        "Serial",
        "InfoKindVersion",
        "Text",
        F.lit(None).cast("array<float>").alias("embedding"),
        F.col("_key").alias("unique_event_id"),
        tokyo_time(time).alias("obs_jst"),
        F.char_length("Text").alias("text_chars"),
        event_year(time).alias("event_year"),
        event_bucket(F.col("EventID")).alias("event_bucket"),
    )
