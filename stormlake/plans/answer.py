"""Questions to contexts and prompts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import answer_prompts, assemble_context
from ..operators.embed import DIMENSIONS, embed
from ..operators.questions import parse_questions, resolve_questions, storm_names
from ..operators.retrieve import match_questions
from ..operators.similarity import RETRIEVER_K, top_k
from ..operators.windows import window_contexts
from ..session import stage

HIT = ("question_id", "mode", "place", "obs_jst", "id_", "Text", "text_chars")


def structured_hits(bounded: DataFrame, documents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    return match_questions(bounded, documents, names).withColumn("place", F.lit(0))


def fallback_hits(
    failed: DataFrame, documents: DataFrame, index: DataFrame, k: int = RETRIEVER_K
) -> DataFrame:
    """The k most similar documents of every question that failed the gate, best first.

    ``index`` holds ``unique_event_id, embedding``. Equal questions are searched once.
    """
    texts = failed.select(F.sha2("question", 256).alias("_text_id"), "question", "question_id")
    distinct = texts.select("_text_id", "question").dropDuplicates(["_text_id"])
    vectors = embed(distinct, "_text_id", "question", DIMENSIONS)
    # k rows per distinct text, searched once whatever reads the hits
    found = stage(top_k(vectors, index, k, "_text_id", "unique_event_id", DIMENSIONS), "similar")
    placed = texts.join(found, "_text_id").select(
        "question_id", "unique_event_id", F.col("rank").alias("place")
    )
    hits = documents.join(placed, "unique_event_id")
    return hits.withColumn("mode", F.lit("similar"))


def all_contexts(questions: DataFrame, documents: DataFrame, index: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The contexts of every question with ``parsed``, by window or else by similarity."""
    bounded, failed = resolve_questions(questions)
    by_window = window_contexts(bounded, documents, names)
    by_likeness = assemble_context(fallback_hits(failed, documents, index).select(*HIT))
    return by_window.unionByName(by_likeness)


def question_modes(questions: DataFrame) -> DataFrame:
    bounded, failed = resolve_questions(questions)
    columns = [*questions.columns, "mode"]
    return bounded.select(*columns).unionByName(
        failed.withColumn("mode", F.lit("similar")).select(*columns)
    )


def answer_batch(
    questions: DataFrame, documents: DataFrame, index: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """``question_id, mode, part, context, prompt`` for questions in plain text.

    Questions that come with ``parsed`` keep it. The others are parsed once, ahead of
    the branches that need them. ``names`` are the stored ones (``read_names``); without them the documents are
    scanned for theirs.
    """
    # read once: they name the storms in the questions and resolve them in the documents
    names = names if names is not None else stage(storm_names(documents), "names")
    if "parsed" not in questions.columns:
        questions = stage(parse_questions(questions, names), "parsed")
    contexts = all_contexts(questions, documents, index, names)
    answered = answer_prompts(question_modes(questions), contexts)
    return answered.select("question_id", "mode", "part", "context", "prompt")
