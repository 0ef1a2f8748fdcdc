import random
import re

from stormlake.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string"


def brute_force(rows, window):
    """Every window against every other document, in plain Python."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first = {}
    for (key, _), own in zip(rows, words):
        if key is not None:
            for i in range(len(own) - window + 1):
                seen = tuple(own[i : i + window])
                first[seen] = min(first.get(seen, key), key)
    out = []
    for (key, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - window + 1):
            if key is not None and first[tuple(own[i : i + window])] < key:
                gone.update(range(i, i + window))
        out.append((key, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=str)


def ours(spark, rows, window, **options):
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window, **options)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=str)


def test_equals_brute_force_on_overlapping_passages(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    rows = []
    for key in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 30))))
        rows.append((key, rng.choice([" ", "\n", "\t "]).join(parts)))
    for window in (2, 5, 6, 13):
        assert ours(spark, rows, window, group_bytes=700) == brute_force(rows, window)


def test_edge_rows(spark):
    passage = " ".join(f"é{i}" for i in range(20))
    rows = [
        (5, passage), (3, "x " + passage + " y"), (3, passage), (None, passage), (9, None), (9, ""), (8, " \n\t"),
        (7, passage + " " + passage), (6, "word " * 3000 + passage), (4, "short text"), (2, "short text"),
    ]
    assert ours(spark, rows, 13) == brute_force(rows, 13)
    spans = {(r["doc_id"], r["n_words"]): r["spans"] for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(s["start"], s["end"]) for s in spans[(7, 40)]] == [(0, 40)]
    assert spans[(None, 20)] == []


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, chunk int, key string")
    assert remove_repeats(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c", 4, "k"), (2, "a b c", 4, "k")], "doc_id long, text string, chunk int, key string")
    found = {r["doc_id"]: r["kept_text"] for r in remove_repeats(rows, window=3).collect()}
    assert found == {1: "a b c", 2: ""}


def test_a_passage_that_every_document_has(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    rows = [(key, f"{key} {passage} {key}") for key in range(500)]
    found = ours(spark, rows, 13, group_bytes=2000)
    assert found == brute_force(rows, 13)
    assert sum(r[2] for r in found) == 499 * 15
