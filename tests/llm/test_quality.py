"""The ordinal model: held-out ranking, its likelihood, and the cases its docstring names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stormlake.llm.quality import features, fit_ordinal, fit_quality, rate_quality
from stormlake.llm.queries import graded

#: some 2500 ratings: a third of that of the next smaller table ranks little better than chance
SF = "/root/testdata/sf0.1"


def auc(scores, good):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    n = good.sum()
    return (order[good].sum() - n * (n + 1) / 2) / (n * (~good).sum())


def likelihood(model, index, first, grades):
    tails = model.tails(model.scores(index, first))
    whole = np.hstack([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))])
    rows = np.arange(len(grades))
    return float(np.log(np.maximum(whole[rows, grades] - whole[rows, grades + 1], 1e-12)).mean())


def test_held_out_grades_are_ranked(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), graded(spark.read.parquet(f"{SF}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = fit_quality(docs, labels.where(~held), n_grades=3)
    rated = rate_quality(docs, model).join(labels.where(held).groupBy("doc_id").agg(F.min("grade").alias("grade")), "doc_id")
    rows = rated.where("grade is not null").select("quality_tail", "quality_grade", "grade").toPandas()
    assert len(rows) > 100
    grade = rows.grade.to_numpy()
    tail, expected = (auc(rows[c].to_numpy(), g) for c, g in (("quality_tail", grade == 2), ("quality_grade", grade > 0)))
    assert (tail > 0.8, expected > 0.8) == (True, True), (tail, expected)


def test_a_fit_beats_the_shares_of_the_grades_and_thresholds_rise():
    rng = np.random.default_rng(3)
    words = [["bad", "worse"], ["fair", "plain"], ["good", "great"]]
    grades = rng.integers(0, 3, 300)
    texts = [" ".join(rng.choice(words[g] + ["the", "a", "of"], 12)) for g in grades]
    index, first = features(pa.array(texts), 14)
    model = fit_ordinal(index, first, grades, 3, 14)
    shares = np.bincount(grades) / len(grades)
    assert likelihood(model, index, first, grades) > float((shares * np.log(shares)).sum()) + 0.5
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails(model.scores(index, first))
    assert (tails[:, 0] >= tails[:, 1] - 1e-12).all() and ((tails >= 0) & (tails <= 1)).all()


def test_ratings_out_of_range_null_or_repeated(spark):
    docs = spark.createDataFrame([(n, "good text" if n % 2 else "bad words") for n in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(n, 2 if n % 2 else 0) for n in range(40)], "doc_id long, grade int")
    odd = spark.createDataFrame([(None, 2), (1, None), (2, 7), (3, -1), (5, 2)], "doc_id long, grade int")
    one, two = fit_quality(docs, ratings, 3), fit_quality(docs, ratings.unionByName(odd), 3)
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
    kept = {r.doc_id for r in rate_quality(docs, one).where("quality_kept").collect()}
    assert kept == {n for n in range(40) if n % 2}


def test_nothing_to_learn_from_and_nothing_to_rate(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = fit_quality(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert rate_quality(docs, model).count() == 2
    assert rate_quality(docs.limit(0), model).count() == 0


def test_null_empty_long_repeated_texts_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "word " * 300_000, "x"), (4, "word " * 300_000, "x"), (None, "good", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_tail string")
    some = spark.createDataFrame([(n, "good text" if n % 2 else "bad words") for n in range(40)], "doc_id long, text string")
    model = fit_quality(some, spark.createDataFrame([(n, 2 if n % 2 else 0) for n in range(40)], "doc_id long, grade int"), 3)
    found = rate_quality(docs, model).collect()
    assert len(found) == 6 and all(isinstance(r.quality_tail, float) for r in found)
    bare = {r.doc_id: r.quality_tail for r in found if r.doc_id in (1, 2, 3)}
    assert len(set(bare.values())) == 1
    assert len({r.quality_tail for r in found if r.doc_id == 4}) == 1
