import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stormlake.llm.lexical import Batch, ShardTree, bounds, item_batches, length_norms, search_ranked, walk

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items, k):
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, counts) for key, counts in held if counts]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, counts in held:
            m = 100 - 75 + (75 * sum(counts.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms(text) if t in counts
            )
            if score > 0:
                scores.append((-score, key is None, key or 0))
        for rank, (score, gone, key) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if gone else key, -score))
    return sorted(out, key=str)


def ours(spark, docs, items, **options):
    rows = search_ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(120)] + ["the", "Éa", "x_y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", "-", ". "]).join(rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.randint(0, 60))) for i in range(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]
    docs += [(None, docs[3][1]), (None, None), (900, None), (901, ""), (902, " -- "), (5, docs[6][1]), (5, docs[6][1])]
    docs += [(903, text(9000)), (904, "THE the The " * 50)]
    items = [(i, text(rng.randint(1, 25))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "unseen words"), (103, "the THE w1 w1"), (3, items[3][1]), (3, "w2"), (None, "w3 w4")]
    return docs, items


@pytest.mark.parametrize("options", [
    {}, {"k": 3, "opening": 2, "shard_bytes": 900}, {"k": 1, "block_terms": 60, "batch_cells": 200, "shard_bytes": 3000},
])
def test_equals_brute_force(spark, corpus, options):
    docs, items = corpus
    assert ours(spark, docs, items, **options) == brute_force(docs, items, options.get("k", 10))


def test_clashing_columns_and_text_keys(spark):
    docs = spark.createDataFrame([("b", "x y", 1, 2), ("a", "x y", 1, 2), (None, "x y", 1, 2)], "doc string, body string, item long, score int")
    items = spark.createDataFrame([("q", "x", 0)], "name string, words string, rank int")
    rows = search_ranked(docs, items, "doc", "body", "name", "words").collect()
    assert [(r["name"], r["rank"], r["doc"]) for r in sorted(rows, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "")])])
def test_nothing_to_find(spark, docs, items):
    assert ours(spark, docs, items) == []


def test_norms_beyond_64_bits():
    n = np.array([3, 10**9], np.int64)
    assert length_norms(n, 10**11, 10**13).tolist() == [25 + 75 * int(x) * 10**11 // 10**13 for x in n]


def made_trees(rng, n_docs, n_items, n_terms, topics):
    doc, term, often = [], [], []
    for d in range(n_docs):
        topic = rng.randrange(topics)
        mine = {topic * (n_terms // topics) + rng.randrange(n_terms // topics) for _ in range(12)}
        for t in sorted(mine):
            doc.append(d), term.append(t), often.append(rng.randint(1, 1000))
    first, terms = [0], []
    for _ in range(n_items):
        topic = rng.randrange(topics)
        terms += sorted({topic * (n_terms // topics) + rng.randrange(n_terms // topics) for _ in range(8)})
        first.append(len(terms))
    weights = np.array([rng.randint(1, 50) for _ in terms], np.int64)
    first, terms = np.array(first), np.array(terms)
    doc, term, often = (np.array(x, np.int64) for x in (doc, term, often))
    return first, terms, weights, doc, term, often


def test_bounds_hold_and_prune_most_pairs():
    rng = random.Random(2)
    n_docs, n_items = 3000, 60
    first, terms, weights, doc, term, value = made_trees(rng, n_docs, n_items, 400, 40)
    (numbers,) = item_batches(first, terms, weights)
    batch = Batch(numbers, first, terms, weights)
    local = np.minimum(np.searchsorted(batch.terms, term), len(batch.terms) - 1)
    mine = batch.terms[local] == term
    tree = ShardTree(doc[mine], local[mine], value[mine], value[mine])
    dense = np.zeros((n_docs, len(batch.terms)), np.int64)
    dense[doc[mine], local[mine]] = value[mine]
    scores = dense @ batch.levels[0].T
    # a node's product is never under that of any pair below it
    for i, rows in enumerate(batch.levels):
        for j, level in enumerate(tree.levels):
            q, d = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(level[0]) - 1), indexing="ij"))
            upper = bounds(rows, q, level, d).reshape(len(rows), -1)
            below_d, below_q = np.arange(len(tree.docs)) // 8**j, np.arange(len(numbers)) // 4**i
            assert (upper[below_q][:, below_d] >= scores[tree.docs].T).all()
    floor = np.ones(n_items, np.int64)
    kept = {}

    def found(q, d, s):
        for item, document, score in zip(q.tolist(), d.tolist(), s.tolist()):
            kept.setdefault(item, {})[document] = score
        for item, rows in kept.items():
            if len(rows) >= 10:
                floor[item] = sorted(rows.values())[-10]

    taken = walk(batch, tree, lambda: floor, found)
    assert taken < 0.4 * n_docs * n_items
    for at, item in enumerate(numbers.tolist()):
        want = sorted(scores[:, at][scores[:, at] > 0])[-10:]
        assert sorted(kept.get(item, {}).values())[-10:] == want


def test_batches_hold_every_item_once_within_the_cells():
    rng = random.Random(4)
    first, terms, weights, *_ = made_trees(rng, 1, 200, 400, 40)
    parts = item_batches(first, terms, weights, cells=300)
    assert sorted(i for part in parts for i in part.tolist()) == list(range(200))
    assert len(parts) > 5
    for part in parts:
        assert len(part) == 1 or len(part) * sum(first[i + 1] - first[i] for i in part) <= 300
