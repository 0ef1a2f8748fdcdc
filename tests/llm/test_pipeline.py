"""Each stage of the pipeline against a plain one, on a small folder with awkward rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stormlake.llm.mixing import plan_mix, take_mix, token_count
from stormlake.llm.queries import MIX_LEVELS, MIX_WEIGHTS, with_domain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def words(n, start):
    return " ".join(f"w{start + i}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with near copies, a benchmark passage, repeated lines, null ids and texts, and a column ``_key``."""
    path = str(tmp_path_factory.mktemp("sf"))
    line = "this very line of many plain words stands in several documents of the table"
    rows = [
        (1, words(60, 0)), (2, words(60, 0) + " tail"), (3, words(60, 500)), (3, words(60, 500)),
        (4, words(20, 900) + " " + ITEM.upper() + " " + words(5, 950)), (5, line + "\n" + words(30, 1000)),
        (6, words(30, 2000) + "\n" + line), (7, line), (8, None), (9, ""), (None, words(60, 0)), (None, None),
    ]
    df = spark.createDataFrame([(k, t, "en", "src1", len(t or ""), "mine") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `_key` string")
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q", ITEM), (None, None), ("short", "nowhere to be seen")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.limit(0).write.parquet(f"{path}/labels.parquet")
    return path


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def content(df):
    return sorted(((r.doc_id, r.text, r["_key"]) for r in df.collect()), key=repr)


def shingles(text, n=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def test_near_copies_leave_the_smallest_id(spark, folder):
    rows = content(docs(spark, folder))
    keyed = [(k, shingles(t)) for k, t, _ in rows if k is not None]
    dropped = {
        b for a, x in keyed for b, y in keyed if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)
    }
    assert dropped == {2}
    assert content(cp.near_copies(spark, docs(spark, folder), folder)) == [r for r in rows if r[0] not in dropped]


def test_documents_with_a_benchmark_passage_go(spark, folder):
    item = re.findall(r"\w+", ITEM)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}

    def hit(text):
        found = re.findall(r"\w+", (text or "").lower())
        return any(tuple(found[i : i + 10]) in windows for i in range(len(found)))

    rows = content(docs(spark, folder))
    assert [r[0] for r in rows if hit(r[1])] == [4]
    assert content(cp.decontaminated(spark, docs(spark, folder), folder)) == [r for r in rows if not hit(r[1])]


def test_repeated_lines_stay_where_they_come_first(spark, folder):
    found = {r[0]: r[1] for r in content(cp.lines(spark, docs(spark, folder), folder)) if r[0] is not None}
    assert found[5] == docs(spark, folder).where("doc_id = 5").first().text
    assert found[6].strip() == words(30, 2000) and 7 not in found
    assert found[8] is None and found[9] == "" and found[4] is not None


def test_a_table_without_ratings_is_judged_without_loss_of_rows_or_columns(spark, folder):
    kept = cp.quality(spark, docs(spark, folder), folder)
    assert kept.columns == docs(spark, folder).columns and set(content(kept)) <= set(content(docs(spark, folder)))


def test_mixing_takes_what_its_operator_takes(spark, folder):
    given = docs(spark, folder)
    placed = with_domain(given)
    plan = plan_mix(placed.withColumn("n_tokens", token_count("text")), MIX_LEVELS, MIX_WEIGHTS)
    plain = take_mix(placed, plan, MIX_LEVELS)
    found = cp.mixed(spark, given, folder)
    assert found.columns == [*given.columns, "domain", "epoch"]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.select(*found.columns).collect()))


def test_an_empty_table_passes_every_stage(spark, folder, tmp_path):
    empty = docs(spark, folder).limit(0)
    for name, step in cp.STAGES:
        found = step(spark, empty, folder)
        assert found.count() == 0, name
        assert found.columns[: len(empty.columns)] == empty.columns


def test_every_stage_but_the_last_hands_on_rows_of_documents(spark):
    """The given table: each stage takes rows away from what it was handed, and adds none."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    left = given
    for name, step in cp.STAGES[:-1]:
        before, left = left, cp.written(step(spark, left, SF), "stage")
        assert left.columns == COLUMNS, name
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(left) <= ids(before) and left.count() <= before.count(), name
        if name != "line dedup":
            assert left.exceptAll(before).count() == 0, name
        assert left.count() > 0.3 * given.count(), name
    mix = cp.mixed(spark, left, SF)
    tokens, whole = (df.agg(F.sum(token_count("text"))).first()[0] for df in (mix, left))
    # every leaf ends with the first document that reaches its budget, so it may go beyond by less than one
    longest = with_domain(left).groupBy(*MIX_LEVELS).agg(F.max(token_count("text")).alias("n"))
    beyond, leaves = longest.agg(F.sum("n"), F.count("*")).first()
    assert whole / 2 - leaves - 1 <= tokens < whole / 2 + beyond
    assert ids(mix) <= ids(left)
