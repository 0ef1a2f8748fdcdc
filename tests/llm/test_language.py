import math
import re
from collections import Counter

from pyspark.sql import functions as F

from stormlake.llm import language
from stormlake.llm.language import fit_language, identify
from stormlake.llm.queries import llm_queries

SCHEMA = "doc_id long, text string, lang string"
TRAIN = [
    (1, "the cat and the dog with the bird", "en"), (2, "this is the house and that is the river", "en"),
    (3, "der hund und die katze mit dem vogel", "de"), (4, "das ist das haus und der fluss", "de"),
    (5, None, "en"), (6, "lost words", None), (7, "", "de"),
]


def brute_force(train, text):
    """The same model word by word, with plain dictionaries."""
    words = {}
    for _, t, name in train:
        if t is not None and name is not None:
            words.setdefault(name, Counter()).update(re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted(n for n in words if words[n])
    grams = {n: [Counter() for _ in range(language.LONGEST)] for n in langs}
    for n in langs:
        for word, k in words[n].items():
            for size in range(1, language.LONGEST + 1):
                for i in range(len(word) + 3 - size):
                    grams[n][size - 1][f"^{word}$"[i : i + size]] += k
    own = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not own:
        return "und", 0.0
    total = dict.fromkeys(langs, 0.0)
    for word, k in own.items():
        if any(word in words[n] for n in langs):
            for n in langs:
                total[n] += k * math.log((words[n][word] + language.SMOOTH) / (sum(words[n].values()) + 1))
            continue
        for size in range(language.LONGEST, 0, -1):
            seen = [g for g in (f"^{word}$"[i : i + size] for i in range(len(word) + 3 - size)) if any(g in grams[n][size - 1] for n in langs)]
            if seen:
                for n in langs:
                    table = grams[n][size - 1]
                    mean = sum(math.log((table[g] + language.SMOOTH) / (sum(table.values()) + 1)) for g in seen) / len(seen)
                    total[n] += k * (mean - language.STEP_DOWN * (language.LONGEST - size + 1))
                break
    best = max(langs, key=lambda n: (total[n], [-ord(c) for c in n]))
    return best, 1 / sum(math.exp(max(-700, total[n] - total[best])) for n in langs)


def test_equals_the_model_word_by_word(spark):
    texts = ["the bird", "die vogel", "Katzen und Hunde!", "zzz qqq", "", None, "123 _ --", "thé dögs", "xyz " * 50000, "with dem"]
    model = fit_language(spark.createDataFrame(TRAIN, SCHEMA))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(rows, model).collect()}
    for i, text in enumerate(texts):
        name, score = brute_force(TRAIN, text)
        assert found[i][0] == name
        assert math.isclose(found[i][1], score, abs_tol=1e-9)


def test_untrained_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = fit_language(empty)
    rows = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (None, None, None)], "doc_id long, text string, score int")
    assert [tuple(r) for r in identify(rows, model).collect()] == [(1, "und", 0.0), (1, "und", 0.0), (None, "und", 0.0)]
    assert identify(empty, model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = llm_queries()["op8_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.count() > 100
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
