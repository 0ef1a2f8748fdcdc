"""Packing tokenised documents into training sequences: first-fit decreasing in random groups.

A document longer than a sequence fills whole sequences first; what is left over, less than one
sequence, is packed. Left-overs are dealt into groups at random (a hash of where the row
was read, not of its key, so one key or repeated rows do not meet in one group) of about
``GROUP_TOKENS`` tokens. In a group the longest go first, each into the first bin with room,
which a tournament tree over the bins' free room finds in logarithmic time. Then the few bins
that are neither full nor of a length that needs no padding are levelled: pieces of the emptiest are cut to fill the
fullest, and the last bin is cut into powers of two. No token is padding, and no more than one
piece is cut for each bin that first-fit left open, plus the cuts of the last bin.

A task holds one group, a few megabytes, and the ids of one document. The pieces are
written once to the shared folder, so a lost executor does not change where anything lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.tokens import ByteBpe, Encoder, Segments, worker_kept
from stormlake.llm.words import chunks
from stormlake.session import work_path

LENGTH = 1024
GROUP_TOKENS = 1 << 20
_CHUNK_BYTES = 2 << 20


class RoomTree:
    """A tournament over bins by free room: the winner of each match is the larger one.

    All bins start empty; there are as many as there may be items.
    """

    def __init__(self, n_bins: int, length: int):
        self.size = 1 << max(0, (n_bins - 1).bit_length())
        self.room = [length] * (2 * self.size)

    def place(self, amount: int) -> int:
        """Put ``amount`` into the first bin with that much room and return the bin."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < amount:
                node += 1
        at = node - self.size
        room[node] -= amount
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return at


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The items in each bin, in the order in which they were put there."""
    tree, bins = RoomTree(len(sizes), length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def _no_padding(filled: int, length: int) -> bool:
    return filled == length or filled & (filled - 1) == 0


def levelled(bins: list[list[int]], sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Bins of ``(item, start, length)`` pieces, none of which needs padding."""
    whole = [[(item, 0, sizes[item]) for item in items] for items in bins]
    filled = [sum(sizes[item] for item in items) for items in bins]
    done = [pieces for pieces, size in zip(whole, filled) if _no_padding(size, length)]
    # fullest first; the emptiest, at the end, give
    open_bins = sorted(((size, i) for i, size in enumerate(filled) if not _no_padding(size, length)), reverse=True)
    taking, giving = [whole[i] for _, i in open_bins], len(open_bins) - 1
    at = 0
    while at < giving:
        room = length - sum(p[2] for p in taking[at])
        while room and at < giving:
            item, start, size = taking[giving].pop()
            moved = min(size, room)
            if moved < size:
                taking[giving].append((item, start, size - moved))
            taking[at].append((item, start + size - moved, moved))
            room -= moved
            if not taking[giving]:
                giving -= 1
        if not room:
            done.append(taking[at])
            at += 1
    if at == giving and at >= 0 and taking:
        done.extend(_powers(taking[at], length))
    return [pieces for pieces in done if pieces]


def _powers(pieces: list[tuple[int, int, int]], length: int) -> list[list[tuple[int, int, int]]]:
    """One bin as several whose lengths are powers of two (or the whole length), largest first."""
    total, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while total:
        room = length if total >= length else 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            item, start, size = pieces.pop()
            taken = min(size, room)
            out[-1].append((item, start, taken))
            if taken < size:
                pieces.append((item, start + taken, size - taken))
            room -= taken
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    end_id: int = 0, group_tokens: int = GROUP_TOKENS, seed: int = 29,
) -> DataFrame:
    """``key, start, length, doc_tokens, sequence_id, offset, ids``, a row for each piece of a document.

    ``tokenizer`` is the path of a byte-level BPE in JSON form, read on the driver. A document is its ids
    followed by ``end_id``; ``start`` counts its ids before the piece, ``ids`` holds the
    piece's ids as little-endian unsigned 32-bit numbers. In each sequence the offsets run on from 0
    without a gap. A sequence is ``length`` long or a power of two, so nothing is padded.

    A null or empty text is the one token ``end_id``. Every row is a document of its own, also
    those that repeat a key or have none; other columns are left out. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[key].dataType
    fields = [T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("row", T.LongType()), T.StructField("whole", T.BooleanType())])

    def cut(batches):
        encoder = worker_kept(("packing", hash(raw.value)), lambda: Encoder(ByteBpe(raw.value, special=True)))
        base, n_rows, n_whole = TaskContext.get().partitionId() << 32, 0, 0
        for batch in chunks(batches, "text", _CHUNK_BYTES):
            segments = Segments(batch.column("text"), encoder.tokenizer.cuts)
            ids, first = encoder.encode(segments, segments.hashes())
            ends = first[segments.first]
            flat = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            sizes = np.diff(ends)
            pieces = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, sizes[doc] - start)
            whole = size == length
            numbers = np.cumsum(whole) - whole + n_whole
            places = ends[doc] + start
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(sizes[doc]),
                    pa.array(2 * (base + numbers), mask=~whole), pa.array(np.zeros(len(doc), np.int64), mask=~whole),
                    pa.array([flat[p : p + n].tobytes() for p, n in zip(places.tolist(), size.tolist())], pa.binary()),
                    pa.array(base + n_rows + np.arange(len(doc))), pa.array(whole),
                ],
                names=schema.names,
            )
            n_rows += len(doc)
            n_whole += int(whole.sum())

    path = work_path(spark, "pieces")
    cuts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)
    # ids are small numbers in four bytes each: the stronger codec halves them
    cuts.write.option("compression", "zstd").partitionBy("whole").parquet(path)
    pieces = spark.read.schema(schema).parquet(path)
    rest = pieces.where(~F.col("whole"))
    total = rest.agg(F.sum("length")).first()[0] or 0
    n_groups = max(1, -(-total // group_tokens))
    group = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n_groups))

    def packed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row")
        number = table["group"][0].as_py()
        sizes = table["length"].to_pylist()
        bins = levelled(first_fit_decreasing(sizes, length), sizes, length)
        rows = [(item, start, size, at) for at, one in enumerate(bins) for item, start, size in one]
        item, start, size, at = (np.array(x, np.int64) for x in zip(*rows))
        ends = np.cumsum(size)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        offset = ends - size - np.repeat((ends - size)[heads], np.diff(np.append(heads, len(at))))
        ids = table["ids"].to_pylist()
        return pa.table(
            [
                table["key"].take(pa.array(item)), pa.array(start + table["start"].to_numpy()[item]), pa.array(size),
                table["doc_tokens"].take(pa.array(item)), pa.array(2 * ((number << 32) + at) + 1), pa.array(offset),
                pa.array([ids[i][4 * s : 4 * (s + n)] for i, s, n, _ in rows], pa.binary()),
            ],
            names=names,
        )

    names = [*(f.name for f in fields), "ids"]
    filled = rest.withColumn("group", group).groupBy("group").applyInArrow(packed, T.StructType([schema[n] for n in names]))
    return pieces.where("whole").select(*names).unionByName(filled).withColumnRenamed("key", key)
