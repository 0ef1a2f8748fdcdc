"""Benchmark decontamination with a positional inverted index of the training text.

``build_index`` cuts the documents into shards of about ``SHARD_BYTES`` of text; a task
sorts the words of each shard into posting lists of positions and the index is written to
the shared folder: one row per shard, with its terms, list lengths and gaps between positions.
``search_index`` looks for windows of item words. In every shard a window starts from
the list of its rarest term there; its positions, moved by the term's offset, are
intersected with the lists of the other terms, rarest first. Terms that a shard lacks
end a window at once. Nothing is shuffled but the matches.

The items are the stated query set: they are met with the index in blocks of ``BLOCK_WINDOWS``
windows, each of which is broadcast (some 100 bytes a window) and read once per shard, so memory
does not grow with the number of items. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.words import Words, chunks
from stormlake.session import stage

WINDOW = 10
SHARD_BYTES = 4 << 20
#: item windows that are searched in one pass over the index
BLOCK_WINDOWS = 200_000
#: candidate positions that are intersected at a time inside a task
_CANDIDATES = 1 << 20


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: small ones compress to about a byte."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: ``shard, keys, n_words, terms, lengths, gaps``.

    Every row is a shard: the keys and word counts of its documents in order, its distinct terms as
    sorted hashes, and for each term the gaps between its positions, counted in words from the
    start of the shard. A null text has no words but is a document of its shard.
    """
    schema = T.StructType([
        T.StructField("shard", T.LongType()),
        T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("gaps", T.BinaryType()),
    ])

    def indexed(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in chunks(batches, "text", shard_bytes):
            words = Words(batch.column("text"), "plain", lower=True)
            hashes = words.hashes()
            order = np.argsort(hashes, kind="stable")
            terms, begins, lengths = np.unique(hashes[order], return_index=True, return_counts=True)
            gaps = np.diff(order, prepend=0)
            gaps[begins] = order[begins]
            whole = np.array([0, batch.num_rows], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made]), pa.ListArray.from_arrays(whole, batch.column("key")),
                    pa.ListArray.from_arrays(whole, pa.array(words.counts(), pa.int64())),
                    pa.array([terms.tobytes()]), pa.array([_packed(lengths)]), pa.array([_packed(gaps)]),
                ],
                names=schema.names,
            )
            made += 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(indexed, schema), "positional-index")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, terms``: term hashes of every ``window`` consecutive words of an item.

    An item of fewer words, but not none, is one window. Keys are cast to strings; a window
    of a row without a key has a null ``item``.
    """

    def cut(batches):
        for batch in chunks(batches, "text", 1 << 20):
            words = Words(batch.column("text"), "plain", lower=True)
            hashes = words.hashes().view(np.int64)
            found_items, found_terms = [], []
            for i, name in enumerate(batch.column("item").to_pylist()):
                own = hashes[words.first[i] : words.first[i + 1]]
                if len(own):
                    size = min(window, len(own))
                    views = np.lib.stride_tricks.sliding_window_view(own, size)
                    found_terms.extend(views)
                    found_items.extend([name] * len(views))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_items, pa.string()), pa.array(found_terms, pa.list_(pa.int64()))], names=["item", "terms"]
            )

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, terms array<bigint>").distinct()


class _Block:
    """Some distinct windows, as a matrix of term numbers, and the items that have each."""

    def __init__(self, items: list, terms: list):
        sizes = np.array([len(t) for t in terms])
        flat = np.concatenate(terms).view(np.uint64) if len(terms) else np.zeros(0, np.uint64)
        self.terms, numbers = np.unique(flat, return_inverse=True)
        matrix = np.full((len(terms), sizes.max(initial=1)), -1, dtype=np.int64)
        matrix[np.arange(matrix.shape[1])[None, :] < sizes[:, None]] = numbers
        self.matrix, self.window_of = np.unique(matrix, axis=0, return_inverse=True)
        self.window_of = self.window_of.ravel()
        self.sizes = (self.matrix >= 0).sum(axis=1)
        order = np.argsort(self.window_of, kind="stable")
        names = sorted({i for i in items if i is not None})
        at = {name: i for i, name in enumerate(names)}
        self.names = names + [None]
        self.item = np.array([at.get(i, len(names)) for i in items], dtype=np.int64)[order]
        self.first = np.searchsorted(self.window_of[order], np.arange(len(self.matrix) + 1))


def _search(block: _Block, terms, lengths, gaps, doc_first, slack: int):
    """``window, place, exact`` of all matches in one shard; place is that of the window's first word."""
    begins = np.concatenate([[0], np.cumsum(lengths)])
    at = np.minimum(np.searchsorted(terms, block.terms), max(len(terms) - 1, 0))
    have = (terms[at] == block.terms) if len(terms) else np.zeros(len(block.terms), bool)
    count = np.where(have, lengths[at] if len(terms) else 0, 0)
    real = block.matrix >= 0
    often = np.where(real, count[np.maximum(block.matrix, 0)], np.iinfo(np.int64).max)
    live = np.flatnonzero((often > 0).all(axis=1))
    none = np.zeros(0, np.int64)
    if not len(live):
        return none, none, np.zeros(0, bool)
    # positions of the needed terms, as one sorted array of (term number, position)
    needed = np.flatnonzero(have)
    spans = count[needed]
    inner = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    picked = gaps[np.repeat(begins[at[needed]], spans) + inner]
    sums = np.cumsum(picked)
    heads = np.cumsum(spans) - spans
    positions = sums - np.repeat(sums[heads] - picked[heads], spans)
    keys = (np.repeat(needed, spans) << 40) | positions
    head_of = np.zeros(len(block.terms), dtype=np.int64)
    head_of[needed] = heads
    rarest_first = np.argsort(often[live], axis=1, kind="stable")
    out = []
    load = often[live, rarest_first[:, 0]]
    cuts = np.flatnonzero(np.diff(np.cumsum(load) // _CANDIDATES)) + 1
    for part in np.split(np.arange(len(live)), cuts):
        window, order, loads = live[part], rarest_first[part], load[part]
        owner = np.repeat(np.arange(len(part)), loads)
        inner = np.arange(loads.sum()) - np.repeat(np.cumsum(loads) - loads, loads)
        offset = order[:, 0]
        anchor = positions[head_of[block.matrix[window, offset]][owner] + inner]
        place = anchor - offset[owner]
        doc = np.searchsorted(doc_first, anchor, side="right") - 1
        low, high = doc_first[doc], doc_first[doc + 1]
        size = block.sizes[window][owner]
        good = (place >= low - slack) & (place + size <= high + slack)
        owner, place, low, high, exact = owner[good], place[good], low[good], high[good], np.ones(good.sum(), bool)
        for j in range(1, order.shape[1]):
            offset = order[owner, j]
            number = block.matrix[window[owner], offset]
            here = number >= 0
            wanted = place + offset
            least = (np.maximum(number, 0) << 40) | np.maximum(wanted - slack, low)
            most = (np.maximum(number, 0) << 40) | np.minimum(wanted + slack, high - 1)
            found = keys[np.minimum(np.searchsorted(keys, least), len(keys) - 1)]
            good = ~here | ((found >= least) & (found <= most))
            if slack:
                centre = (np.maximum(number, 0) << 40) | np.maximum(wanted, 0)
                exact &= ~here | (keys[np.minimum(np.searchsorted(keys, centre), len(keys) - 1)] == centre)
            owner, place, low, high, exact = owner[good], place[good], low[good], high[good], exact[good]
            if not len(owner):
                break
        if slack:
            exact &= (place >= low) & (place + block.sizes[window[owner]] <= high)
        out.append((window[owner], place, exact))
    return tuple(np.concatenate(x) for x in zip(*out))


def search_index(index: DataFrame, windows: DataFrame, slack: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``shard, place, matches`` of every document with a match; ``place`` numbers the documents of a shard.

    ``matches`` is an array of ``{item, start, end, exact}`` in words of the document: the
    stretches that windows of the item cover, overlapping ones joined. With ``slack`` 0 all are exact phrases. With a
    larger one a window also matches where each of its words lies within ``slack`` places of where
    it stands relative to the rarest word; such stretches are reported apart, as not exact.
    """
    total = windows.count()
    n_blocks = max(1, -(-total // block_windows))
    bucket = F.pmod(F.when(F.col("item").isNull(), F.xxhash64("terms")).otherwise(F.xxhash64("item")), F.lit(n_blocks))
    match = "array<struct<item:string,start:int,end:int,exact:boolean>>"
    found = None
    for number in range(n_blocks):
        rows = windows.where(bucket == number).toArrow()
        lists = rows.column("terms").combine_chunks() if rows.num_rows else None
        shared = index.sparkSession.sparkContext.broadcast(
            (rows.column("item").to_pylist(), [np.asarray(x.values) for x in lists] if lists is not None else [])
        )

        def matched(batches, shared=shared):
            block = None
            for batch in batches:
                if not shared.value[0]:
                    continue
                block = block or _Block(*shared.value)
                for i in range(batch.num_rows):
                    terms = np.frombuffer(batch.column("terms")[i].as_py(), np.uint64)
                    lengths = _unpacked(batch.column("lengths")[i].as_py())
                    gaps = _unpacked(batch.column("gaps")[i].as_py())
                    doc_first = np.concatenate([[0], np.cumsum(np.array(batch.column("n_words")[i].as_py(), np.int64))])
                    places, rows = _documents(block, *_search(block, terms, lengths, gaps, doc_first, slack), doc_first)
                    if places:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column("shard")[i].as_py()] * len(places), pa.int64()), pa.array(places, pa.int32()),
                             pa.array(rows, pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())])))],
                            names=["shard", "place", "matches"],
                        )

        part = index.select("shard", "n_words", "terms", "lengths", "gaps").mapInArrow(matched, f"shard long, place int, matches {match}")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("shard", "place").agg(F.flatten(F.collect_list("matches")).alias("matches"))


def _documents(block: _Block, window, place, exact, doc_first):
    """Matches of a shard by document, with overlapping stretches of one item joined."""
    if not len(window):
        return [], []
    middle = np.clip(place + block.sizes[window] // 2, 0, doc_first[-1] - 1)
    doc = np.searchsorted(doc_first, middle, side="right") - 1
    start = np.maximum(place, doc_first[doc])
    end = np.minimum(place + block.sizes[window], doc_first[doc + 1])
    # a window shared by several items counts for each
    spans = block.first[window + 1] - block.first[window]
    each = np.repeat(np.arange(len(window)), spans)
    item = block.item[np.repeat(block.first[window], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)]
    doc, start, end, exact = doc[each], start[each], end[each], exact[each]
    order = np.lexsort((start, exact, item, doc))
    doc, start, end, exact, item = doc[order], start[order], end[order], exact[order], item[order]
    places: list[int] = []
    rows: list[list[dict]] = []
    last = None
    for d, i, s, e, x in zip(doc.tolist(), item.tolist(), start.tolist(), end.tolist(), exact.tolist()):
        if not places or places[-1] != d:
            places.append(d)
            rows.append([])
            last = None
        base = int(doc_first[d])
        if last is not None and last["item"] == block.names[i] and last["exact"] == x and s - base <= last["end"]:
            last["end"] = max(last["end"], e - base)
        else:
            last = {"item": block.names[i], "start": s - base, "end": e - base, "exact": x}
            rows[-1].append(last)
    return places, rows


def find_contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, slack: int = 0,
) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, matches, contaminated`` for every row of ``docs``.

    Words are runs of ASCII digits, letters (A-Z as a-z) and non-ASCII characters. ``n_hit`` counts the
    words inside any match, ``items`` are the distinct item keys as sorted strings. A document without words, or a null
    text, has no matches; items without words match nothing; matches of items without a key
    count for ``n_hit`` but not for ``items``. Repeated rows are each judged; other columns are left out.
    """
    index = build_index(docs, key, text)
    found = search_index(index, item_windows(items, item_key, item_text, window), slack)
    rows = index.select("shard", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "document"))
    span = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    covered = F.aggregate(
        span,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda held, s: F.struct(
            (held["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], held["end"]))).alias("n"),
            F.greatest(held["end"], s["end"]).alias("end"),
        ),
        lambda held: held["n"],
    )
    names = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda name: name.isNotNull())))
    matches = F.coalesce("matches", F.expr("array()").cast("array<struct<item:string,start:int,end:int,exact:boolean>>"))
    return (
        rows.join(found, ["shard", "place"], "left")
        .withColumn("matches", matches)
        .withColumns({"n_hit": covered, "items": names})
        .select(
            F.col("document.keys").alias(key), F.col("document.n_words").alias("n_words"), "n_hit",
            F.size("items").cast("long").alias("n_items"), "items", "matches", (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
