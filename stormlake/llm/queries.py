"""The registered queries of this subpackage, each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from stormlake.llm.align import align_chunks, score_links
from stormlake.llm.ann import build_lists, search_lists
from stormlake.llm.decontaminate import find_contamination
from stormlake.llm.html_text import extract_text
from stormlake.llm.language import fit_language, identify
from stormlake.llm.lexical import search_ranked
from stormlake.llm.line_dedup import dedup_lines
from stormlake.llm.mixing import plan_mix, take_mix, token_count
from stormlake.llm.near import near_duplicates
from stormlake.llm.quality import fit_quality, rate_quality
from stormlake.llm.sequences import pack_documents
from stormlake.llm.substring import remove_repeats
from stormlake.llm.url_filter import judge_urls
from stormlake.session import stage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def llm_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graded(labels: DataFrame) -> DataFrame:
    """Ordered grades: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, by inner product, of every vector whose id is divisible by 20."""
    index = build_lists(_table(spark, sf_dir, "embeddings"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search_lists(index, index.vectors.where(F.col("key") % 20 == 0))
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), "score")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), "contaminated")


#: fixed values: action, host and path
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    found = judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return extract_text(_table(spark, sf_dir, "pages"))


MIX_LEVELS = ("domain", "lang", "source")
#: weights of nodes among their siblings; sources share evenly
MIX_WEIGHTS = {
    "web": 0.4, "books": 0.35, "reference": 0.2, "other": 0.05,
    "*/en": 0.5, "*/de": 0.2, "*/es": 0.15, "*/fr": 0.15,
}


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources 0 to 9 are web, 10 to 14 books, 15 and on reference, anything else other."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,9})$", 1)
    number = F.when(number != "", number.cast("int"))
    domain = F.when(number < 10, "web").when(number < 15, "books").when(number >= 15, "reference").otherwise("other")
    return docs.withColumn("domain", domain)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, mixed to the target weights; a row per document and epoch."""
    docs = with_domain(_table(spark, sf_dir, "documents"))
    rows = stage(docs.select("doc_id", *MIX_LEVELS, token_count("text").alias("n_tokens")), "mix-rows")
    plan = stage(plan_mix(rows, MIX_LEVELS, MIX_WEIGHTS), "mix-plan")
    return take_mix(rows, plan, MIX_LEVELS)


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their word pairs."""
    return near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats, but for one word at most."""
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learned = docs.where(remainder != 0)
    model = fit_language(learned)
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, graded(_table(spark, sf_dir, "labels")), n_grades=3)
    return rate_quality(docs, model).drop("text")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document of smaller id has."""
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, in sequences of 1024 tokens or a power of two."""
    pieces = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, and how common the links are."""
    docs = _table(spark, sf_dir, "documents")
    found = align_chunks(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))

    def digested(doc):
        digest = F.when(doc["groups"] == "", "").otherwise(F.sha2(doc["groups"], 256))
        return doc.dropFields("groups").withField("groups_sha256", digest)

    return score_links(found.withColumn("docs", F.transform("docs", digested)))


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return search_ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
