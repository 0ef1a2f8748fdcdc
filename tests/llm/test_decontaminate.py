import random
import re

from stormlake.llm.decontaminate import find_contamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, items, window):
    out = []
    for key, text in docs:
        own, hit, names = words(text), set(), set()
        for item, item_text in items:
            wanted = words(item_text)
            n = min(window, len(wanted))
            for j in range(len(wanted) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == wanted[j : j + n]:
                        hit.update(range(i, i + n))
                        names.add(str(item))
        out.append((key, len(own), len(hit), len(names), tuple(sorted(names)), bool(hit)))
    return sorted(out, key=str)


def ours(spark, docs, items, window):
    found = find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=window)
    rows = found.collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"] or ()), r["contaminated"]) for r in rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14)))) for i in range(30)]
    docs = [(i, "-".join(rng.choice("ABcdeFGé") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(60 + i, f"x {text} y {text}") for i, (_, text) in enumerate(items)]
    docs += [(0, docs[0][1]), (None, items[3][1]), (200, None), (201, ""), (202, "a b c " * 400)]
    items += [(98, None), (99, ""), (7, items[7][1])]
    assert ours(spark, docs, items, 4) == brute_force(docs, items, 4)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a b")], 10) == []
    assert ours(spark, [(1, "a b")], [], 10) == [(1, 2, 0, 0, (), False)]
