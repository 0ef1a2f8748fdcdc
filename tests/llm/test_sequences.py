import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from stormlake.llm.sequences import RoomTree, _no_padding, first_fit_decreasing, levelled, pack_documents

JSON = path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def plain_first_fit(sizes, length):
    bins, room = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for at, free in enumerate(room):
            if free >= sizes[item]:
                break
        else:
            at = len(bins)
            bins.append([])
            room.append(length)
        bins[at].append(item)
        room[at] -= sizes[item]
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_tree_equals_a_scan_of_the_bins(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 7, 64, 100])
    sizes = [rng.randint(1, length) for _ in range(rng.randint(1, 300))]
    assert first_fit_decreasing(sizes, length) == plain_first_fit(sizes, length)


@pytest.mark.parametrize("seed", range(30))
def test_levelled_bins_need_no_padding_and_lose_nothing(seed):
    rng = random.Random(seed)
    length = rng.choice([64, 100, 1024])
    sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 200))]
    bins = levelled(first_fit_decreasing(sizes, length), sizes, length)
    parts = defaultdict(list)
    for pieces in bins:
        assert pieces and _no_padding(sum(n for _, _, n in pieces), length)
        for item, start, n in pieces:
            assert n > 0
            parts[item].append((start, n))
    assert len(parts) == len(sizes)
    for item, pieces in parts.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == sizes[item]


def test_room_tree_takes_the_first_bin_with_room():
    tree = RoomTree(4, 10)
    assert [tree.place(n) for n in (6, 5, 4, 5, 9)] == [0, 1, 0, 1, 2]


def tokens(text):
    return Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids + [0]


def checked(rows, docs, length):
    """Every id lies in one piece, sequences have no gap and need no padding."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length and _no_padding(at, length)
    want = defaultdict(list)
    for key, text in docs:
        want[key].append(tokens(text))
    assert set(want) == set(pieces)
    for key, texts in want.items():
        if len(texts) == 1:
            assert [i for _, ids, _ in sorted(pieces[key]) for i in ids] == texts[0]
            assert {n for _, _, n in pieces[key]} == {len(texts[0])}
        else:
            assert sorted(i for _, ids, _ in pieces[key] for i in ids) == sorted(i for t in texts for i in t)


def test_round_trip(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["storm", "naïve", "漢字", "x1,", "\n", "  "]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    docs += [(None, "no key"), (None, None), (500, None), (501, ""), (7, docs[7][1]), (7, docs[7][1]), (502, "<|endoftext|> a <|endoftext|>")]
    docs += [(503, "long words " * 3000), (504, "y" * 5000)]
    frame = spark.createDataFrame([(i, t, "z", 1, "w") for i, t in docs], f"{DOCS}, key string, row int, ids string")
    for group in (100, 1 << 20):
        rows = pack_documents(frame, JSON, length=64, group_tokens=group).collect()
        checked(rows, docs, 64)


def test_hot_key_and_repeated_rows_are_dealt_over_groups(spark):
    docs = [(1, "same text")] * 400
    rows = pack_documents(spark.createDataFrame(docs, DOCS), JSON, length=64, group_tokens=100).collect()
    assert sum(r["length"] for r in rows) == 400 * len(tokens("same text"))
    # a group's number is in the upper half of its sequences' ids
    assert len({r["sequence_id"] >> 33 for r in rows}) > 5


def test_whole_sequences_and_exact_multiples(spark):
    ids = tokens("a b c d e f g")
    rows = pack_documents(spark.createDataFrame([(1, "a b c d e f g")], DOCS), JSON, length=len(ids)).collect()
    assert [(r["start"], r["length"], r["offset"]) for r in rows] == [(0, len(ids), 0)]


def test_checksums_are_those_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a")], DOCS)
    for r in pack_documents(docs, JSON, length=4).selectExpr("ids", "crc32(ids) AS crc").collect():
        assert r["crc"] == zlib.crc32(bytes(r["ids"]))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), JSON).collect() == []
