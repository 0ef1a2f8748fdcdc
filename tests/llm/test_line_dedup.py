import random
import re

from stormlake.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string"


def words_of(line):
    return tuple(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, min_words):
    lines = []
    for row, (key, text) in enumerate(rows):
        for number, line in enumerate((text or "").split("\n") if text is not None else []):
            lines.append((key, number, words_of(line), row))
    gone = {}
    for key, number, words, row in lines:
        if key is None or len(words) < min_words:
            continue
        if any(
            k is not None and len(w) >= min_words and (k, m) < (key, number) and one_edit(words, w) for k, m, w, _ in lines
        ):
            gone.setdefault(row, set()).add(number)
    out = []
    for row, (key, text) in enumerate(rows):
        own = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(row, ()))
        out.append((key, own, sorted(gone.get(row, ()))))
    return sorted(out, key=str)


def ours(spark, rows, min_words, **options):
    found = dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=min_words, **options).collect()
    assert all(r["n_removed"] == len(r["removed_lines"]) for r in found)
    return sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in found), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))] for _ in range(25)]

    def line():
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(own) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                own.insert(at, rng.choice("abcdxyz"))
            elif own and kind == 1:
                del own[min(at, len(own) - 1)]
            elif own:
                own[min(at, len(own) - 1)] = rng.choice("ABCDXYZ")
        return rng.choice([" ", "  ", "\t"]).join(own)

    rows = [(key, "\n".join(line() for _ in range(rng.randint(0, 6)))) for key in rng.sample(range(1000), 90)]
    for min_words in (3, 5):
        assert ours(spark, rows, min_words, group_bytes=600) == brute_force(rows, min_words)


def test_edge_rows(spark):
    line = "one two three four five six seven eight nine"
    rows = [
        (4, line), (2, "x\n" + line + "\r\n" + line), (3, line.upper()), (None, line), (5, None), (6, ""), (6, "\n\n"),
        (7, line.replace("five", "5")), (8, line + " ten\nshort line\nshort line"), (9, "é " * 20000 + "\n" + line), (2, line),
        (10, "one two three four FIVE six seven eight"),
    ]
    assert ours(spark, rows, 8) == brute_force(rows, 8)


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    line = "a b c d e f g h"
    rows = spark.createDataFrame([(1, line, 7, "k"), (2, line, 8, None)], "doc_id long, text string, chunk int, n_lines string")
    found = {r["doc_id"]: (r["text"], r["chunk"], r["n_lines"]) for r in dedup_lines(rows).collect()}
    assert found == {1: (line, 7, 1), 2: ("", 8, 1)}


def test_a_template_that_every_document_has(spark):
    rows = [(key, f"copyright by author number {key} all rights are reserved here\nown {key}") for key in range(400)]
    found = ours(spark, rows, 8, group_bytes=3000)
    assert [len(r[2]) for r in sorted(found)] == [0] + [1] * 399
