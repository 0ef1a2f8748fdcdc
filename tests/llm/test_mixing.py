"""Budgets against plain water filling, prefixes against sorted epochs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stormlake.llm.mixing import NONE, leaf_budgets, plan_mix, take_mix, token_count

LEVELS = ["domain", "lang"]


def weight(path, weights):
    loose = "*/" * (len(path) - 1) + path[-1]
    return weights.get("/".join(path), weights.get(loose, 1.0))


def fill(have, children):
    """Shares of ``{child: (cap, weight)}``: full children leave the rest to their siblings."""
    shares, open_ = {}, dict(children)
    while open_:
        rate = have / sum(w for _, w in open_.values())
        full = {c: cap for c, (cap, w) in open_.items() if cap <= rate * w}
        if not full:
            return shares | {c: rate * w for c, (_, w) in open_.items()}
        for child, cap in full.items():
            shares[child] = cap
            have -= cap
            del open_[child]
    return shares


def brute_budgets(leaves, weights, budget, epochs):
    """``{(domain, lang): tokens}`` to its budget."""
    usable = {p: t * epochs for p, t in leaves.items() if t > 0 and all(weight(p[: d + 1], weights) > 0 for d in range(len(p)))}
    domains = {}
    for (domain, _), cap in usable.items():
        domains[domain] = domains.get(domain, 0) + cap
    top = fill(budget, {d: (cap, weight((d,), weights)) for d, cap in domains.items()})
    out = {p: 0 for p in leaves}
    for domain, have in top.items():
        below = {p: (cap, weight(p, weights)) for p, cap in usable.items() if p[0] == domain}
        out |= {p: int(share + 1e-6) for p, share in fill(have, below).items()}
    return out


WEIGHTS = {"a": 5.0, "b": 1.0, "c": 0.0, "a/en": 3.0, "*/fr": 0.5, "b/de": 0.0}


@pytest.mark.parametrize("budget", [0, 1, 90, 700, 2500, 100_000])
def test_budgets_equal_water_filling(spark, budget):
    rng = random.Random(budget)
    leaves = {(d, l): rng.choice([0, 3, 40, 400]) for d in "abcde" for l in ("en", "fr", "de")}
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "domain string, lang string, tokens long")
    found = {(r.domain, r.lang): r.budget for r in leaf_budgets(df, LEVELS, WEIGHTS, budget, 2).collect()}
    assert found == brute_budgets(leaves, WEIGHTS, budget, 2)


def test_a_shortage_goes_to_siblings_before_it_goes_to_the_parents_siblings(spark):
    df = spark.createDataFrame([("a", "en", 10), ("a", "fr", 1000), ("b", "en", 1000)], "domain string, lang string, tokens long")
    found = {(r.domain, r.lang): r.budget for r in leaf_budgets(df, LEVELS, {}, 400, 1).collect()}
    assert found == {("a", "en"): 10, ("a", "fr"): 190, ("b", "en"): 200}
    found = {(r.domain, r.lang): r.budget for r in leaf_budgets(df.where("lang = 'en'"), LEVELS, {}, 400, 1).collect()}
    assert found == {("a", "en"): 10, ("b", "en"): 390}


def place(seed, epoch, key):
    return hashlib.md5(f"{seed}|{epoch}|{'' if key is None else key}".encode()).hexdigest()


def brute_taken(rows, budgets, seed, epochs):
    """How often every ``(leaf, key)`` is taken: whole epochs, then the prefix that reaches the rest."""
    taken = {}
    for leaf, budget in budgets.items():
        mine = [(k, t) for p, k, t in rows if p == leaf]
        total = sum(t for _, t in mine)
        whole = min(budget // total, epochs) if total else 0
        rest = budget - whole * total if whole < epochs else 0
        before, places = 0, {}
        for key, tokens in mine:
            places.setdefault(place(seed, whole, key), [key, 0])[1] += tokens
        for _, (key, tokens) in sorted(places.items()):
            taken[leaf, key] = whole + (before < rest)
            before += tokens
    return {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize("budget", [0, 50, 600, 3000, 10**6])
def test_leaves_take_whole_epochs_and_a_prefix(spark, budget):
    rng = random.Random(7)
    rows = [((rng.choice(["a", "b", None]), rng.choice(["en", "fr"])), k if k % 40 else None, rng.choice([0, 1, 5, 30])) for k in range(240)]
    rows += rows[:20]  # repeated rows share a place
    df = spark.createDataFrame([(*p, k, t, "x") for p, k, t in rows], "domain string, lang string, doc_id long, n_tokens long, epoch string")
    plan = plan_mix(df, LEVELS, WEIGHTS, budget, seed=5)
    found = {}
    for r in take_mix(df, plan, LEVELS, seed=5).collect():
        leaf = (r.domain or NONE, r.lang)
        found.setdefault((leaf, r.doc_id), []).append(r.epoch)
    named = [((p[0] or NONE, p[1]), k, t) for p, k, t in rows]
    leaves = {}
    for p, _, t in named:
        leaves[p] = leaves.get(p, 0) + t
    wanted = brute_taken(named, brute_budgets(leaves, WEIGHTS, budget, 2), 5, 2)
    assert {k: max(e) + 1 for k, e in found.items()} == wanted
    copies = {}
    for p, k, _ in named:
        copies[p, k] = copies.get((p, k), 0) + 1
    assert all(sorted(e) == sorted(list(range(wanted[k])) * copies[k]) for k, e in found.items())


def test_clashing_names_survive_and_an_empty_table_gives_an_empty_mix(spark):
    df = spark.createDataFrame(
        [("a", "en", 1, 5, "t", "b", "e", "l", "k")],
        "domain string, lang string, doc_id long, n_tokens long, tokens string, budget string, epochs string, last string, `_key` string",
    )
    taken = take_mix(df, plan_mix(df, LEVELS, {}, 100), LEVELS).collect()
    assert [(r.tokens, r.budget, r.epochs, r.last, r._key, r.epoch) for r in taken] == [("t", "b", "e", "l", "k", n) for n in (0, 1)]
    none = df.limit(0)
    plan = plan_mix(none, LEVELS, {})
    assert plan.count() == 0 and take_mix(none, plan, LEVELS).count() == 0


def test_tokens_are_runs_of_anything_but_white_space(spark):
    texts = [None, "", " \t\n", "a b\x0bc", "　x y"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(token_count("text").alias("n"))
    assert [r.n for r in found.collect()] == [0, 0, 0, 3, 2]
