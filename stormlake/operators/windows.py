"""Contexts of many overlapping windows, every text read and grouped once.

Questions on the same storms share the texts where their windows overlap. The moments of a storm's day are
laid on one line: a document lies as far along as the texts before it are long. A window is then a stretch of that
line, cut into slices as in ``context``, and the ends of all slices cut the line into pieces that none of
them divides. Times and lengths alone decide this; texts are fetched last, each into the one piece it lies in.
A slice is a run of pieces, and equal windows of several questions are put together once.

A piece is never longer than a slice and its last text, so no group holds more, however many documents a
storm or a day has. The sweep itself sorts narrow rows by storm and day.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .context import SLICE_CHARS, instant
from .questions import storm_names
from .retrieve import covered_years, match_names

NO_DAY = "9999-12-31"
#: bounds of a window that covers the whole day: before and after every instant
_FIRST, _LAST = "", "~"
#: at one instant, starts come before documents and ends after them: windows are closed
_START, _DOCUMENT, _END = 0, 1, 2
_LINE = ("circle", "day")
_VIEW = (*_LINE, "begin", "end")
#: the last moment that a window without an end, but with a start, still holds
_OPEN_END = "TIMESTAMP_NTZ '9999-12-31 23:59:59.999998'"


def _circles(asked: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name, circle`` and ``circle, TyphoonName``: wanted names that mean the same storms share a circle.

    A circle is named by the number of its storms and two sums of their hashes: no list of names is gathered.
    """
    met = stage(match_names(asked, names), "circles")
    sums = [
        F.sum(F.xxhash64(c).cast("decimal(38,0)")).cast("string")
        for c in (F.col("TyphoonName"), F.reverse(F.col("TyphoonName")))
    ]
    circles = met.groupBy("name").agg(F.concat_ws(" ", F.count("*").cast("string"), *sums).alias("circle"))
    return circles, met.join(circles, "name").select("circle", "TyphoonName").distinct()


def _moments(named: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """``circle, day, at, id_, event_year, chars`` of the documents of every circle, in the years asked for."""
    years = covered_years(documents, F.col("lo"), F.col("hi"))
    # the planner prunes years at run time for a side that has a filter of its own
    wanted = named.where(F.size(years) > 0).select("circle", F.explode(years).alias("event_year")).distinct().join(members, "circle")
    day = F.when(F.col("obs_jst").isNull(), F.lit(_LAST)).otherwise(F.substring(instant(), 1, 10))
    return documents.join(wanted, ["TyphoonName", "event_year"]).select(
        "circle", day.alias("day"), instant().alias("at"), "id_", "event_year",
        (F.coalesce("text_chars", F.lit(0)) + 1).cast("bigint").alias("chars"),
    )


def _months(first: Column, last: Column, lo: Column, hi: Column) -> Column:
    """The months that a window shares with the days ``first`` to ``last``, as ``yyyy-MM``."""
    begin = F.greatest(F.coalesce(F.trunc(lo.cast("date"), "MM"), first), first)
    end = F.least(F.coalesce(hi.cast("date"), last), last)
    months = F.transform(F.sequence(F.trunc(begin, "MM"), end, F.expr("INTERVAL 1 MONTH")), lambda m: F.date_format(m, "yyyy-MM"))
    return F.when(F.trunc(begin, "MM") <= end, months).otherwise(F.array().cast("array<string>"))


def _day_windows(named: DataFrame, moments: DataFrame) -> DataFrame:
    """``question_id, circle, day, since, until``: every window cut at the days its storms have documents on.

    Windows and days meet by month, so a window meets at most a month of days that it does not hold.
    """
    days = moments.select(*_LINE).distinct()
    dated = F.when(F.col("day") != _LAST, F.to_date("day"))
    spans = days.groupBy("circle").agg(F.min(dated).alias("first"), F.max(dated).alias("last"))
    lo, hi = F.col("lo"), F.col("hi")
    timeless = F.when(lo.isNull() & hi.isNull(), F.array(F.lit(_LAST))).otherwise(F.array().cast("array<string>"))
    months = F.concat(F.coalesce(_months(F.col("first"), F.col("last"), lo, hi), F.array().cast("array<string>")), timeless)
    asked = named.join(spans, "circle").withColumn("month", F.explode(months))
    met = asked.join(days.withColumn("month", F.substring("day", 1, 7)), ["circle", "month"])
    since, until = instant(lo), instant(hi)
    day, timed = F.col("day"), F.col("day") != _LAST
    inside = ~timed | ((lo.isNull() | (F.substring(since, 1, 10) <= day)) & (hi.isNull() | (day <= F.substring(until, 1, 10))))
    whole_start = ~timed | lo.isNull() | (F.substring(since, 1, 10) < day)
    whole_end = ~timed | hi.isNull() | (day < F.substring(until, 1, 10))
    return met.where(inside).select(
        "question_id", *_LINE,
        F.when(whole_start, F.lit(_FIRST)).otherwise(since).alias("since"),
        F.when(whole_end, F.lit(_LAST)).otherwise(until).alias("until"),
    )


def _along(moments: DataFrame, windows: DataFrame) -> DataFrame:
    """Documents and bounds of windows in one order, each with ``place``: the length of the texts before it."""
    bounds = F.explode(
        F.array(
            F.struct(F.col("since").alias("at"), F.lit(_START).alias("kind")),
            F.struct(F.col("until").alias("at"), F.lit(_END).alias("kind")),
        )
    )
    ends = windows.select(*_LINE, bounds.alias("b")).select(*_LINE, "b.*").distinct()
    rows = moments.withColumn("kind", F.lit(_DOCUMENT)).unionByName(ends, allowMissingColumns=True)
    line = Window.partitionBy(*_LINE).orderBy("at", "kind", "id_").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("place", F.coalesce(F.sum("chars").over(line), F.lit(0).cast("bigint")))


def _views(windows: DataFrame, along: DataFrame) -> DataFrame:
    """``question_id`` and the stretch of the line that each of its days takes; empty ones are left out."""
    def place(kind: int, at: str, name: str) -> DataFrame:
        return along.where(F.col("kind") == kind).select(*_LINE, F.col("at").alias(at), F.col("place").alias(name))

    placed = windows.join(place(_START, "since", "begin"), [*_LINE, "since"]).join(place(_END, "until", "end"), [*_LINE, "until"])
    return placed.where(F.col("begin") < F.col("end")).select("question_id", *_VIEW)


def _slices(views: DataFrame, slice_chars: int) -> DataFrame:
    """The slices of all different stretches: ``slice`` numbers them, ``left`` and ``right`` bound them."""
    begin, end = F.col("begin"), F.col("end")
    last = F.floor((end - 1 - begin) / slice_chars).cast("bigint")
    cut = views.select(*_VIEW).distinct().withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    left = begin + F.col("slice") * slice_chars
    return cut.withColumns({"left": left, "right": F.least(left + slice_chars, end)})


def _pieces(along: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The piece of every document that some slice holds, and the pieces of every slice, by number along the line."""
    cuts = slices.select(*_LINE, F.explode(F.array("left", "right")).alias("place")).distinct()
    documents = along.where(F.col("kind") == _DOCUMENT).select(*_LINE, "place", "at", "id_", "event_year")
    rows = documents.withColumn("cut", F.lit(0)).unionByName(cuts.withColumn("cut", F.lit(1)), allowMissingColumns=True)
    line = Window.partitionBy(*_LINE).orderBy("place", F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = stage(rows.withColumn("piece", F.sum("cut").over(line)), "pieces")
    ends = numbered.where("cut = 1")
    bounded = slices.join(
        ends.select(*_LINE, F.col("place").alias("left"), F.col("piece").alias("_from")), [*_LINE, "left"]
    ).join(ends.select(*_LINE, F.col("place").alias("right"), F.col("piece").alias("_to")), [*_LINE, "right"])
    runs = bounded.select(*_VIEW, "slice", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("piece"))
    held = numbered.where("cut = 0").join(runs.select(*_LINE, "piece").distinct(), [*_LINE, "piece"], "left_semi")
    return held.select(*_LINE, "piece", "at", "id_", "event_year"), runs


def window_contexts(
    bounded: DataFrame, documents: DataFrame, names: DataFrame | None = None, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """``question_id, part, context`` of questions with ``question_id, name, lo, hi``.

    The rows are those of ``assemble_context`` over ``match_questions``, which repeat each text for every question.
    ``documents`` holds one row per ``id_``. It is scanned twice, each time only in the years asked for: times and
    lengths first, then the texts. ``names`` spares a scan for the storm names. A question without documents has no
    row; one with a start but no end takes all later documents that have a time.
    """
    hi = F.when(F.col("lo").isNotNull() & F.col("hi").isNull(), F.expr(_OPEN_END)).otherwise(F.col("hi"))
    asked = bounded.select("question_id", "name", "lo", hi.alias("hi"))
    circles, members = _circles(asked, names if names is not None else storm_names(documents))
    named = stage(asked.join(circles, "name").drop("name"), "resolved")
    moments = stage(_moments(named, members, documents), "moments")
    windows = _day_windows(named, moments)
    along = stage(_along(moments, windows), "along")
    views = stage(_views(windows, along), "views")
    held, runs = _pieces(along, _slices(views, slice_chars))

    texts = documents.select("id_", "event_year", "Text").join(held, ["id_", "event_year"])
    entry = F.struct("at", "id_", "Text")
    pieces = texts.groupBy(*_LINE, "piece").agg(
        F.array_join(F.array_sort(F.collect_list(entry))["Text"], " ").alias("text")
    )
    parts = runs.join(pieces, [*_LINE, "piece"]).groupBy(*_VIEW, "slice").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("piece", "text")))["text"], " ").alias("context")
    )
    shown = F.when(F.col("day") == _LAST, F.lit(NO_DAY)).otherwise(F.col("day"))
    part = F.concat_ws(" ", F.lpad(F.lit("0"), 6, "0"), shown, F.lpad(F.col("slice").cast("string"), 6, "0"))
    return views.join(parts, list(_VIEW)).select("question_id", part.alias("part"), "context")
