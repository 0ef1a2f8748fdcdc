"""Removal of repeated passages by fixed-block anchors.

A passage is a window of ``window`` consecutive words; it is removed wherever the same
window also starts in a document with a smaller key. Three steps, each a shuffle of packed
numbers:

1. *Anchors.* Every text is cut into non-overlapping reference blocks of half a window;
   every rolling window of that length probes them. Any window of the full length holds
   a whole reference block of each document that has it, so a position whose probe
   meets no block of another document needs no further work.
2. *Extension.* Around the anchors that met, all full windows send a fingerprint of 80 bits and the
   smallest key that has it.
3. *Removal.* Adjoining removed windows form the maximal exact repeats, which are cut out.

Documents are dealt into groups of about ``GROUP_BYTES`` of text by a hash of key and text.
A group sends each distinct hash once, so a passage that a third of all documents share arrives once
per group, not once per document. The text is shuffled once; the three steps read
the same exchange. Nothing is capped and no list of matches between documents is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.packing import bits, dealt, from_bits, from_planes, planes, table_of
from stormlake.llm.words import Words, whole, window_hashes

WINDOW = 13
#: text of one group of documents, the unit that a task holds in memory
GROUP_BYTES = 6 << 20
_TAIL_BITS = 40


class _Group:
    """The documents of one group that have a key, in the order of their keys."""

    def __init__(self, table: pa.Table, window: int):
        batch = table.combine_chunks()
        self.keys_column, self.texts = batch.column("key").combine_chunks(), batch.column("text").combine_chunks()
        self.window, self.block = window, (window + 1) // 2
        self.words = Words(self.texts, "spaced", lower=False)
        self.hashes = self.words.hashes()
        self.row = self.words.row_of_word()
        keyed = self.keys_column.is_valid().to_numpy(zero_copy_only=False)
        self.keys = self.keys_column.fill_null(0).to_numpy()
        self.keyed_word = keyed[self.row]

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Distinct probe hashes, sorted; whether a reference block has it; whether two keys
        have it; position and inverse of every probe."""
        h = window_hashes(self.hashes, self.block)
        at = np.flatnonzero(whole(self.words.first, self.block) & self.keyed_word[: len(h)])
        in_text = at - self.words.first[self.row[at]]
        distinct, back = np.unique(h[at], return_inverse=True)
        aligned = np.zeros(len(distinct), dtype=bool)
        aligned[back[in_text % self.block == 0]] = True
        return distinct, aligned, self._several(back, self.keys[self.row[at]], len(distinct)), at, back

    @staticmethod
    def _several(back: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        low = np.full(n, np.iinfo(np.int64).max)
        high = np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, back, keys)
        np.maximum.at(high, back, keys)
        return low < high

    def windows(self, active: np.ndarray, at: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start positions of the full windows around active anchors and their two hashes."""
        n = len(self.hashes)
        hits = at[active[back]]
        edges = np.zeros(n + 2, dtype=np.int64)
        reach = self.window - self.block
        np.add.at(edges, np.maximum(hits - reach, 0), 1)
        np.add.at(edges, hits + 1, -1)
        h = window_hashes(self.hashes, self.window)
        near = np.cumsum(edges)[: len(h)] > 0
        at = np.flatnonzero(near & whole(self.words.first, self.window) & self.keyed_word[: len(h)])
        second = window_hashes(self.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A), self.window)[at].astype(np.uint16)
        return at, h[at], second


def _window_rows(group: _Group, active, at, back):
    """Distinct windows sorted by both hashes: hashes, smallest key, several keys, and every
    window's position and distinct number."""
    start, h, second = group.windows(active, at, back)
    keys = group.keys[group.row[start]]
    order = np.lexsort((second, h))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
    begins = np.flatnonzero(fresh)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    low = np.minimum.reduceat(keys[order], begins) if len(begins) else keys[:0]
    high = np.maximum.reduceat(keys[order], begins) if len(begins) else keys[:0]
    return h[order][begins], second[order][begins], low, low < high, start, number


def _active(group: _Group, replies: pa.Table, n_buckets: int):
    distinct, _, _, at, back = group.anchors()
    active = np.zeros(len(distinct), dtype=bool)
    parts = dealt(distinct, n_buckets) if replies.num_rows else []
    for bucket, flags in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        active[parts[bucket]] = from_bits(flags, len(parts[bucket]))
    return active, at, back


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``key, n_words, n_removed, spans, kept_text`` for every row.

    Words are runs of anything but ASCII white space. ``spans`` are the removed stretches
    ``{start, end}`` in words, ``kept_text`` is what is left, joined by single spaces. Windows are
    judged on the input. Keys are integers; of rows that repeat a key none removes the other's windows.
    A row without a key keeps all its words and removes nothing elsewhere. A null or empty
    text, or one shorter than a window, has nothing to remove; its kept text is its words
    (an empty string if none). Other columns are left out; join on the key for them.
    """
    block = (window + 1) // 2
    if window < 2:
        raise ValueError("a window has at least two words")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // group_bytes))
    groups = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int"))

    def send_anchors(chunk, table):
        group = _Group(table, window)
        distinct, aligned, several, _, _ = group.anchors()
        out: dict[str, list] = {c: [] for c in ("bucket", "chunk", "low", "high", "aligned", "several")}
        for bucket, own in enumerate(dealt(distinct, n)):
            if len(own):
                tails = distinct[own] >> np.uint64(64 - _TAIL_BITS)
                out["bucket"].append(bucket)
                out["chunk"].append(chunk[0].as_py())
                out["low"].append(planes(tails.astype(np.uint32)))
                out["high"].append((tails >> np.uint64(32)).astype(np.uint8).tobytes())
                out["aligned"].append(bits(aligned[own]))
                out["several"].append(bits(several[own]))
        kinds = {"bucket": pa.int32(), "chunk": pa.int32()}
        return table_of({c: (v, kinds.get(c, pa.binary())) for c, v in out.items()})

    def meet_anchors(bucket, table):
        tails, aligned, several, sizes = [], [], [], []
        for low, high, a, s in zip(*(table.column(c).to_pylist() for c in ("low", "high", "aligned", "several"))):
            sizes.append(len(high))
            tails.append(from_planes(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)))
            aligned.append(from_bits(a, len(high)))
            several.append(from_bits(s, len(high)))
        distinct, back, count = np.unique(np.concatenate(tails), return_inverse=True, return_counts=True)
        has_block, shared = np.zeros(len(distinct), dtype=bool), count > 1
        has_block[back[np.concatenate(aligned)]] = True
        shared[back[np.concatenate(several)]] = True
        parts = np.split((has_block & shared)[back], np.cumsum(sizes)[:-1])
        kept = [(c, bits(p)) for c, p in zip(table.column("chunk").to_pylist(), parts) if p.any()]
        return table_of({
            "chunk": ([c for c, _ in kept], pa.int32()), "bucket": ([bucket[0].as_py()] * len(kept), pa.int32()),
            "bits": ([b for _, b in kept], pa.binary()),
        })

    def send_windows(chunk, table, replies):
        out: dict[str, list] = {c: [] for c in ("bucket", "chunk", "hashes", "seconds", "lows", "several")}
        if table.num_rows and replies.num_rows:
            group = _Group(table, window)
            h, second, low, several, _, _ = _window_rows(group, *_active(group, replies, n))
            for bucket, own in enumerate(dealt(h, n)):
                if len(own):
                    out["bucket"].append(bucket)
                    out["chunk"].append(chunk[0].as_py())
                    out["hashes"].append(planes(h[own]))
                    out["seconds"].append(planes(second[own]))
                    out["lows"].append(planes(low[own]))
                    out["several"].append(bits(several[own]))
        kinds = {"bucket": pa.int32(), "chunk": pa.int32()}
        return table_of({c: (v, kinds.get(c, pa.binary())) for c, v in out.items()})

    def meet_windows(bucket, table):
        columns = {c: table.column(c).to_pylist() for c in ("hashes", "seconds", "lows", "several")}
        sizes = [len(x) // 8 for x in columns["hashes"]]
        h = np.concatenate([from_planes(x, np.uint64) for x in columns["hashes"]])
        second = np.concatenate([from_planes(x, np.uint16) for x in columns["seconds"]])
        low = np.concatenate([from_planes(x, np.int64) for x in columns["lows"]])
        several = np.concatenate([from_bits(x, k) for x, k in zip(columns["several"], sizes)])
        order = np.lexsort((second, h))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
        begins = np.flatnonzero(fresh)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        smallest = np.minimum.reduceat(low[order], begins)
        shared = np.diff(np.append(begins, len(order))) > 1
        shared |= np.maximum.reduceat(several[order], begins)
        flags = np.split(shared[number], np.cumsum(sizes)[:-1])
        lows = np.split(smallest[number], np.cumsum(sizes)[:-1])
        kept = [(c, bits(f), planes(v[f])) for c, f, v in zip(table.column("chunk").to_pylist(), flags, lows) if f.any()]
        return table_of({
            "chunk": ([k[0] for k in kept], pa.int32()), "bucket": ([bucket[0].as_py()] * len(kept), pa.int32()),
            "flags": ([k[1] for k in kept], pa.binary()), "lows": ([k[2] for k in kept], pa.binary()),
        })

    def cut(chunk, table, replies):
        anchored = replies.filter(replies.column("bits").is_valid())
        windowed = replies.filter(replies.column("flags").is_valid())
        group = _Group(table, window)
        removed = np.zeros(len(group.words), dtype=bool)
        if windowed.num_rows:
            h, _, _, _, start, number = _window_rows(group, *_active(group, anchored, n))
            smallest = np.full(len(h), np.iinfo(np.int64).max)
            parts = dealt(h, n)
            for bucket, flags, lows in zip(*(windowed.column(c).to_pylist() for c in ("bucket", "flags", "lows"))):
                own = parts[bucket]
                smallest[own[from_bits(flags, len(own))]] = from_planes(lows, np.int64)
            gone = start[smallest[number] < group.keys[group.row[start]]]
            edges = np.zeros(len(removed) + 1, dtype=np.int64)
            np.add.at(edges, gone, 1)
            np.add.at(edges, gone + window, -1)
            removed = np.cumsum(edges[:-1]) > 0
        return _results(group, removed)

    def _results(group, removed):
        words = group.words
        sums = np.concatenate([[0], np.cumsum(removed)])
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        spans, kept = [], []
        raw = words.raw.tobytes()
        starts, ends = words.start.tolist(), words.end.tolist()
        for i in range(len(words.first) - 1):
            low, high = int(words.first[i]), int(words.first[i + 1])
            own = removed[low:high]
            kept.append(b" ".join([raw[starts[j] : ends[j]] for j in (np.flatnonzero(~own) + low).tolist()]).decode("utf-8", "replace"))
            edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
            spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())] if own.any() else [])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({
            "key": group.keys_column, "n_words": pa.array(words.counts(), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(span)), "kept_text": pa.array(kept, pa.string()),
        })

    sent = groups.groupBy("chunk").applyInArrow(
        send_anchors, "bucket int, chunk int, low binary, high binary, aligned binary, several binary"
    )
    met = sent.groupBy("bucket").applyInArrow(meet_anchors, "chunk int, bucket int, bits binary")
    shown = groups.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(
        send_windows, "bucket int, chunk int, hashes binary, seconds binary, lows binary, several binary"
    )
    smallest = shown.groupBy("bucket").applyInArrow(meet_windows, "chunk int, bucket int, flags binary, lows binary")
    nothing = F.lit(None).cast("binary")
    replies = met.select("chunk", "bucket", "bits", nothing.alias("flags"), nothing.alias("lows")).unionByName(
        smallest.select("chunk", "bucket", nothing.alias("bits"), "flags", "lows")
    )
    result = groups.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        cut, "key long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    )
    return result.withColumnRenamed("key", key)
