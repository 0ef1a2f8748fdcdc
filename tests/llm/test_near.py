import random
import re

import numpy as np

from stormlake.llm import near
from stormlake.llm.components import connected_components, extended_components
from stormlake.llm.near import furthest, near_duplicates

SCHEMA = "doc_id long, text string"


def brute_force(rows, n, percent):
    sets = []
    for _, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        if len(words) < n:
            sets.append({tuple(words)} if words else set())
        else:
            sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    keys = [k for k, _ in rows]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if keys[i] is None or keys[j] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(keys[i]), find(keys[j])
                root[max(a, b)] = min(a, b)
    return sorted(((k, len(s), find(k) if k is not None else None, k is None or find(k) == k) for k, s in zip(keys, sets)), key=str)


def ours(spark, rows, n, percent):
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), n=n, percent=percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for family in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            base = edited(base, rng, rng.randint(0, max(1, len(base) // 25)))
            rows.append((rng.randrange(10**9), " ".join(base)))
            if rng.random() < 0.3:
                rows.append((rng.randrange(10**9), " ".join(base).upper()))
    rng.shuffle(rows)
    assert ours(spark, rows, 2, 80) == brute_force(rows, 2, 80)
    assert ours(spark, rows, 5, 80) == brute_force(rows, 5, 80)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 1000}x{i // 7}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Two one"), (None, "one"), (None, None),
        (8, long), (9, long + " end"), (8, "one two"), (10, "one two"),
    ]
    assert ours(spark, rows, 2, 80) == brute_force(rows, 2, 80)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "a b", 5, 6), (2, "a b", 5, 6)], "doc_id long, text string, node int, root int")
    assert sorted(near_duplicates(clash, n=2).select("doc_id", "kept").collect()) == [(1, True), (2, False)]


def test_a_chain_whose_ends_differ_is_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(60):
        rows.append((step, " ".join(words)))
        words = words[1:] + [f"n{step}"]
    found = ours(spark, rows, 2, 80)
    assert found == brute_force(rows, 2, 80)
    assert {r[2] for r in found} == {0}


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1000, 1000), (None, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    assert roots == {**{i: 0 for i in range(1, 300)}, 1001: 1000}


def test_components_extended_by_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    of = lambda some: spark.createDataFrame(some, "a long, b long")
    roots = extended_components(connected_components(of(links[:45]), "a", "b"), of(links[45:]), "a", "b").collect()
    whole = connected_components(of(links), "a", "b").collect()
    assert sorted(roots) == sorted(whole) and len(whole) > 20


def test_sketch_margin_keeps_what_may_be_linked():
    # differing bits of pairs at the threshold stay well below the bound
    rng = np.random.default_rng(0)
    apart = []
    for _ in range(2000):
        differing = rng.binomial(400, 0.2)
        flips = np.bincount(rng.integers(0, 1024, 2 * differing), minlength=1024) & 1
        apart.append(flips.sum())
    assert max(apart) < furthest(0.8)


def replaced(words, at, tag):
    return [f"{tag}x{i}" if i in at else word for i, word in enumerate(words)]


def test_outsiders_of_a_large_group_are_not_confirmed_with_all_its_members(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(replaced(words, {rng.randrange(1, 99)}, f"m{i}"))) for i in range(60)]
    # three quarters alike to every member, and to each other less
    rows += [(100 + i, " ".join(replaced(words, set(rng.sample(range(2, 98, 3), 6)), f"o{i}"))) for i in range(40)]
    confirm, met = near.confirm, []

    def counted(pairs, *more):
        met.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(near, "confirm", counted)
    assert ours(spark, rows, 2, 80) == brute_force(rows, 2, 80)
    assert len(met) == 3 and met[-1] <= len(rows)


def test_the_last_meeting_misses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "RARE", 4)
    rng = random.Random(6)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(2, 80))]
        rows += [" ".join(edited(base, rng, rng.randint(0, max(1, len(base) // 10)))) for _ in range(rng.choice([2, 3, 9]))]
    rows = list(enumerate(dict.fromkeys(rows)))
    texts = spark.createDataFrame(rows, "node long, text string")
    # all in one band, each a component of its own
    rest = texts.selectExpr("0L AS band", "node", "node AS root", "0L AS largest")
    rare, common = near._rare_and_common(rest, near.shingle_rows(texts, 2), 80)
    found = {(r["a"], r["b"]) for r in near._sharing_rare(rare, 80).collect()}
    by_counts = {r["node"]: (r["common"], r["size"]) for r in common.collect()}
    sets = [set(zip(text.split(), text.split()[1:])) for _, text in rows]
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    plain = {n for n, (shared, size) in by_counts.items() if 100 * shared >= 80 * size}
    apart = [p for p in linked if p not in found]
    assert len(linked) > 30 and len(apart) < len(linked)
    assert all(180 * min(by_counts[i][0], by_counts[j][0]) >= 80 * (len(sets[i]) + len(sets[j])) for i, j in apart if {i, j} <= plain)
    assert all({i, j} <= plain for i, j in apart)


def test_outsiders_just_below_the_threshold_meet_few_members(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    rows += [(i, " ".join(replaced(words, set(rng.sample(range(1, 148, 3), rng.randint(1, 3))), f"m{i}"))) for i in range(1, 90)]
    # 18 of 149 shingles are not the center's: a similarity of 0.77 to it, and less to its copies; they have common shingles that these have not
    rows += [(100 + i, " ".join([*replaced(words, set(rng.sample(range(1, 148, 3), 9)), f"o{i}"), "t0", "t1", "t2"])) for i in range(70)]
    confirm, met = near.confirm, []

    def counted(pairs, *more):
        met.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(near, "confirm", counted)
    found = ours(spark, rows, 2, 80)
    assert found == brute_force(rows, 2, 80)
    assert sum(r[3] for r in found) == 71
    # without the center each of the outsiders is confirmed with most of the members
    assert len(met) == 3 and met[-1] <= len(rows)


def test_meeting_by_common_shingles_misses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "RARE", 3)
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(2, 80))]
        rows += [" ".join(edited(base, rng, rng.randint(0, max(1, len(base) // 10)))) for _ in range(rng.choice([4, 9, 20]))]
    rows = list(enumerate(dict.fromkeys(rows)))
    texts = spark.createDataFrame(rows, "node long, text string")
    # two bands, in one of which a component of three is the largest
    rest = texts.selectExpr("node % 2 AS band", "node", "if(node in (1, 3, 5), 1, node) AS root", "if(node % 2 = 1, 1L, 0L) AS largest")
    rare, plain = near._rare_and_common(rest, near.shingle_rows(texts, 2), 80)
    rare_met = {(r["a"], r["b"]) for r in near._sharing_rare(rare, 80).collect()}
    common_met = {(r["a"], r["b"]) for r in near._sharing_common(rest, plain, 80).collect()}
    sets = [set(zip(text.split(), text.split()[1:])) for _, text in rows]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (j - i) % 2 == 0 and not {i, j} <= {1, 3, 5}]
    linked = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(linked - rare_met) > 5 and linked <= rare_met | common_met
    assert len(common_met) < len(pairs) / 4
