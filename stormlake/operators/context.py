"""Context assembly and prompts.

A question may match most of the corpus, so its context is not one row by force. The same
rule cuts every context, large or small: a part for each place (the rank of a similar
document; 0 for documents found by their window), day, and slice of the day. A new slice begins
where the texts of the day before it reach another ``SLICE_CHARS``. Nothing is left out, and
joining the parts of a question in the order of ``part`` with one space gives its whole context.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ANSWER_PROMPT
from .documents import fill

SLICE_CHARS = 4_000_000
_NO_TIME = "9999-12-31 23:59:59.999999"


def instant(time: Column | None = None) -> Column:
    """Sort text of a time, by default the observation time; rows without one come last."""
    time = F.col("obs_jst") if time is None else time
    return F.coalesce(F.rpad(time.cast("string"), 26, " "), F.lit(_NO_TIME))


def assemble_context(hits: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``question_id, part, context``: texts in order of place, time and id, joined by a space.

    ``hits`` holds ``question_id, place, obs_jst, id_, Text, text_chars``. ``part`` is place, day and
    slice; texts without a time share the last day, 9999-12-31.
    """
    day = F.substring(instant(), 1, 10)
    placed = hits.select(
        "question_id", F.lpad(F.col("place").cast("string"), 6, "0").alias("place"), day.alias("day"), "text_chars",
        F.struct(instant().alias("instant"), "id_", "Text").alias("entry"),
    )
    order = Window.partitionBy("question_id", "place", "day").orderBy("entry.instant", "entry.id_")
    before = F.sum(F.col("text_chars") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(before, F.lit(0)) / slice_chars).cast("string")
    sliced = placed.withColumn("part", F.concat_ws(" ", "place", "day", F.lpad(number, 6, "0")))
    grouped = sliced.groupBy("question_id", "part").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return grouped.select(
        "question_id", "part", F.array_join(F.col("entries.Text"), " ").alias("context")
    )


def answer_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions with ``part, context, prompt``; no hit leaves an empty context.

    A question with several parts gets one whole prompt per part.
    """
    joined = questions.join(contexts, "question_id", "left")
    filled = joined.withColumns(
        {
            "part": F.coalesce("part", F.lit("")),
            "context": F.coalesce("context", F.lit("")),
        }
    )
    values = {"context": F.col("context"), "query": F.col("question")}
    return filled.withColumn("prompt", fill(ANSWER_PROMPT, values))
