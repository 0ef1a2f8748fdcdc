import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from stormlake.llm.align import align, align_chunks, common_ends, score_links

JSON, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
#: fixed values: the letters of a byte-level vocabulary that do not stand for their own byte
SHIFTED = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256)]


def byte_of(letter):
    return SHIFTED[ord(letter) - 256] if ord(letter) >= 256 else ord(letter)


class Plain:
    """The definition, one text at a time."""

    def __init__(self):
        self.a = Tokenizer.from_file(JSON)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def groups(self, text):
        if not text:
            return []
        want = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(byte_of(c) for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            return []
        a_ends, b_ends = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (a_bytes, b_bytes))
        out, begin_a, begin_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            stop_a, stop_b = a_ends.index(end) + 1, b_ends.index(end) + 1
            out.append((a[begin_a:stop_a], b[begin_b:stop_b]))
            begin_a, begin_b = stop_a, stop_b
        return out

    def rows(self, docs):
        found = [(key, self.groups(text)) for key, text in docs]
        links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
        counts = Counter(pair for one in links for pair in one)
        best = defaultdict(int)
        for (a, _), n in counts.items():
            best[a] = max(best[a], n)
        out = []
        for (key, groups), one in zip(found, links):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((
                key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(one.values()),
                sum(n for (a, b), n in one.items() if counts[a, b] == best[a]), sum(n * counts[p] for p, n in one.items()), text,
            ))
        return sorted(out, key=str)


def ours(spark, docs, **options):
    rows = score_links(align_chunks(spark.createDataFrame(docs, DOCS), JSON, MODEL, **options)).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(20))
def test_common_ends_equal_set_intersection(seed):
    rng = random.Random(seed)
    a, b, a_first, b_first, want_a, want_b, base = [], [], [0], [0], [], [], 0
    for _ in range(rng.randint(0, 12)):
        size = rng.choice([0, 1, 5, 300, 3000])
        lists = []
        for _ in range(2):
            ends = sorted(rng.sample(range(1, size + 1), rng.randint(1, size))) if size else []
            lists.append(sorted({*ends, size}) if size else [])
        for i, end in enumerate(lists[0]):
            if end in set(lists[1]):
                want_a.append(len(a) + i)
                want_b.append(len(b) + lists[1].index(end))
        a += [base + e for e in lists[0]]
        b += [base + e for e in lists[1]]
        a_first.append(len(a)), b_first.append(len(b))
        base += size
    got_a, got_b = common_ends(*(np.array(x, np.int64) for x in (a, a_first, b, b_first)))
    assert got_a.tolist() == want_a and got_b.tolist() == want_b


def test_equals_brute_force(spark):
    rng = random.Random(8)
    parts = ["storm", "naïve", "漢字かな", " ", "  ", "\n", "\t", "x1,", "unbelievable", "😀", "<s>", "<|endoftext|>", "<0x41>", "Ünïcode", "123456", "\x00", "e.g.", "'s"]
    docs = [(i, rng.choice([" ", ""]).join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(None, "no key"), (None, None), (500, None), (501, ""), (502, " "), (503, "a▁b"), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(504, "word " * 2000), (505, "q" * 3000), (506, " " * 700), (507, "ก" * 400), (508, "  lead"), (509, "trail  ")]
    docs += [(600 + i, "the same text, again") for i in range(30)]
    want = Plain().rows(docs)
    assert ours(spark, docs) == want
    assert ours(spark, docs, chunk_pairs=50) == want


def test_a_group_without_common_ends_inside(spark, monkeypatch):
    import stormlake.llm.align as module

    monkeypatch.setattr(module, "_LINKS", 3)
    made = object.__new__(module._Aligned)
    made.a, made.b = np.array([5, 6, 5, 9], np.int32), np.array([1, 2, 1, 7], np.int32)
    made.a_last, made.b_last = np.array([2, 3]), np.array([2, 3])
    made.n_a, made.n_b = np.array([3, 1]), np.array([3, 1])
    made.group_first = np.array([0, 2])
    codes, times = made.pairs(0)
    assert dict(zip([(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()], times.tolist())) == {
        (5, 1): 4, (5, 2): 2, (6, 1): 2, (6, 2): 1, (9, 7): 1,
    }
    assert made.group_strings().to_pylist() == ["5,6,5|1,2,1;9|7"]


def test_empty_table_and_extra_columns(spark):
    assert ours(spark, []) == []
    frame = spark.createDataFrame([(1, "a b", "x", 2, 3)], f"{DOCS}, groups string, n_a int, chunk long")
    (row,) = score_links(align_chunks(frame, JSON, MODEL)).collect()
    assert (row["doc_id"], row["n_a"], row["groups"]) == (1, 2, "257|264;275|287")
    assert align(frame, JSON, MODEL).drop("groups").collect() == [(1, 2, 2, 2, 2)]


def test_chunks_are_short_and_few_share_a_file(spark):
    docs = [(i, f"storm number {i} " * 20 + "the wind turns, and the sea rises far from land. " * 30) for i in range(100)]
    chunked = align_chunks(spark.createDataFrame(docs, DOCS).coalesce(1), JSON, MODEL, chunk_pairs=1)
    work = Path(spark.conf.get("spark.checkpoint.dir")) / "stormlake"
    before = set(work.glob("link-chunks-*"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert score_links(chunked).count() == 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (made,) = set(work.glob("link-chunks-*")) - before
    rows = [pq.ParquetFile(x).metadata.num_rows for x in made.glob("*.parquet")]
    # a batch of a reader never goes beyond a file
    assert sum(rows) == 100 and max(rows) <= 32
    many = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(200))) for i in range(400)], DOCS).coalesce(1)
    sizes = align_chunks(many, JSON, MODEL).selectExpr("octet_length(place) + octet_length(times) AS n", "aggregate(docs, 0L, (x, d) -> x + d.n_links) AS links")
    for row in sizes.collect():
        assert row["n"] < 4 * row["links"]
