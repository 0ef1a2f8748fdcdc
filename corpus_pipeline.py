"""From raw documents to a training mix, in stages that are each written as Parquet.

``STAGES`` lists them in order. Each takes ``(spark, docs, sf_dir)``, works on all that its
predecessor kept, and returns the columns of ``documents``; the last adds ``domain`` and ``epoch``. Null
texts and ids pass through: what has no words is not rejected by any stage, and a row without an
id is no near copy. Rows that repeat an id are kept or dropped together by near dedup.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.llm.decontaminate import find_contamination
from stormlake.llm.line_dedup import dedup_lines
from stormlake.llm.mixing import plan_mix, take_mix, token_count
from stormlake.llm.near import near_duplicates
from stormlake.llm.quality import fit_quality, rate_quality
from stormlake.llm.queries import MIX_LEVELS, MIX_WEIGHTS, graded, with_domain
from stormlake.session import stage as written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = fit_quality(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), n_grades=3)
    return rate_quality(docs, model).where("quality_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines; a document of which only white space is left goes."""
    found = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies (five-word shingles, 0.8)."""
    dropped = near_duplicates(docs, n=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a ten-word window of a benchmark item."""
    row = F.xxhash64(docs["doc_id"], docs["text"])
    keyed = docs.select(row.alias("row"), "text")
    found = find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
    dropped = found.where("contaminated").select(F.col("row").alias("dropped")).distinct()
    # joined by a value, not by a column of the documents: they may have one of any name
    return docs.join(dropped, row == dropped["dropped"], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens that are left, by the target weights; a row per document and epoch."""
    docs = with_domain(docs)
    rows = written(docs.select("doc_id", *MIX_LEVELS, token_count("text").alias("n_tokens")), "mix-rows")
    plan = written(plan_mix(rows, MIX_LEVELS, MIX_WEIGHTS), "mix-plan")
    return take_mix(docs, plan, MIX_LEVELS)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: the classifier is fitted by gradient steps, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = written(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
