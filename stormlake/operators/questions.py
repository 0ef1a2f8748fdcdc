"""Questions: parse, gate, split and bound in time. One row per question throughout."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import QUESTION_GATE
from ..functions.names import normal_name
from ..functions.times import lenient_time
from .dates import question_moments, start_and_end

def storm_names(documents: DataFrame) -> DataFrame:
    """The distinct storm names of a corpus; counted map-side, a few rows per task."""
    return documents.where(F.col("TyphoonName").isNotNull()).select("TyphoonName").distinct()


def _grams(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` words as (position, length, text)."""
    def run(position: Column, length: Column) -> Column:
        text = F.array_join(F.slice(words, position, length), " ")
        return F.struct(position.alias("at"), length.alias("n"), text.alias("text"))

    def runs_at(position: Column) -> Column:
        most = F.least(F.lit(longest), F.size(words) - position + 1)
        return F.transform(F.sequence(F.lit(1), most), lambda n: run(position, n))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), runs_at))


def _name_key(name: Column) -> Column:
    """Upper case, letters and digits only: the form names are compared in."""
    return F.regexp_replace(F.upper(name), r"(?U)[^\w]+", "")


def find_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``question_id, name``: the words of the question that spell a storm's name.

    Word runs meet the distinct names on equality. The longest run wins, then the first.
    A name of so many letters is spelled in at most so many words, which bounds the runs.
    """
    known = names.select(_name_key(F.col("TyphoonName")).alias("name_key")).where("name_key <> ''").distinct()
    longest = known.agg(F.max(F.length("name_key"))).first()[0] or 1
    spaced = F.regexp_replace(F.col("question"), r"(?U)[^\w]+", " ")
    words = F.split(F.trim(spaced), " ")
    runs = questions.where(F.trim(spaced) != "").select(
        "question_id", F.explode(_grams(words, longest)).alias("run")
    )
    keyed = runs.select(
        "question_id", "run.at", "run.n", "run.text", _name_key(F.col("run.text")).alias("name_key")
    )
    best = F.min_by("text", F.struct(-F.length("name_key"), F.col("at"), F.col("n")))
    return keyed.join(known, "name_key").groupBy("question_id").agg(best.alias("name"))


def parse_questions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``parsed``: ``name, start, end`` in the form the gate expects.

    Dates and their roles are those of ``dates.question_moments``. More than two moments are all
    listed, and a date that is not understood reads ``?``: the gate rejects both.
    """
    found = questions.join(find_names(questions, names), "question_id", "left")
    dated = found.withColumn("_dates", question_moments("question"))
    times = F.when(F.col("_dates.unclear"), F.array(F.lit("?"))).otherwise(start_and_end(F.col("_dates.moments")))
    parts = F.concat(F.array(F.coalesce("name", F.lit("None"))), times)
    return dated.select(*questions.columns, F.array_join(parts, ", ").alias("parsed"))


def gate(questions: DataFrame) -> DataFrame:
    """Add ``gate_ok``: the parsed text has the agreed form."""
    ok = F.coalesce(F.col("parsed").rlike(QUESTION_GATE), F.lit(False))
    return questions.withColumn("gate_ok", ok)


def split_parsed(questions: DataFrame) -> DataFrame:
    """Add the normalised name and the texts of start and end."""
    parts = F.split("parsed", ", ")
    return questions.withColumns(
        {
            "name": normal_name(F.get(parts, F.lit(0))),
            "start_text": F.get(parts, F.lit(1)),
            "end_text": F.get(parts, F.lit(2)),
        }
    )


def question_times(questions: DataFrame) -> DataFrame:
    """Add start and end as wall clocks; ``None`` and impossible dates are null."""
    return questions.withColumns(
        {"start": lenient_time(F.col("start_text")), "end": lenient_time(F.col("end_text"))}
    )


def question_bounds(questions: DataFrame) -> DataFrame:
    """Add ``mode`` and the closed interval ``[lo, hi]``; an open side is null.

    A start at midnight without an end means that whole day.
    """
    start, end = F.col("start"), F.col("end")
    midnight = start.cast("date").cast("timestamp_ntz") == start
    mode = (
        F.when(start.isNotNull() & end.isNotNull(), "range")
        .when(start.isNotNull() & midnight, "day")
        .when(start.isNotNull(), "instant")
        .when(end.isNotNull(), "upto")
        .otherwise("name")
    )
    last = start + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND")
    hi = F.when(F.col("mode") == "day", last).when(F.col("mode") == "instant", start).otherwise(end)
    return questions.withColumn("mode", mode).withColumns({"lo": start, "hi": hi})


def resolve_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split questions with ``parsed`` into bounded ones and those failing the gate."""
    judged = gate(questions)
    passed = question_bounds(question_times(split_parsed(judged.where("gate_ok"))))
    return passed, judged.where(~F.col("gate_ok"))
