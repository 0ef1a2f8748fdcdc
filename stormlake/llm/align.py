"""Alignment of two tokenizers on the same bytes, and how often their tokens meet in a corpus.

A byte-level BPE (A) reads a space and the text, a SentencePiece model (B) the text, which puts that space in
front itself. Tokens are spans of the same bytes, so the places where both end cut them into groups.
``common_ends`` finds those places by galloping: the shorter list of ends of a document drives, and each
of its ends is sought in the longer one from where the last was found, first in doubling steps, then by halving.
Many stretches of many documents take their steps at the same time, as one array. Between common
places the differences of ranks are the numbers of tokens of a group on either side.

``align_chunks`` gives every document its groups and its linked id pairs, ``score_links`` then counts in
how many documents of the corpus each pair is linked. For that the pairs of some documents, a chunk, are
joined into one list of distinct pairs; only these are shuffled, as plain rows summed by Spark, and come back to their
chunk. A chunk holds about ``CHUNK_PAIRS`` pairs, or those of one document. Its lists are compressed, and few
chunks share a file: a reader holds the rows of a file, up to thousands, at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm import packing
from stormlake.llm.tokens import ByteBpe, Encoder, PieceBpe, Segments, ranges, worker_kept
from stormlake.llm.words import chunks
from stormlake.session import stage

CHUNK_PAIRS = 250_000
#: chunks in a file, some ten megabytes
_FILE_CHUNKS = 32
_CHUNK_BYTES = 1 << 18
#: ends that one stretch of a driving list has
_STRETCH = 64
#: links that are written out at a time
_LINKS = 1 << 21


def gallop(driver: np.ndarray, other: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cursor: np.ndarray, stops: np.ndarray):
    """Where ``driver`` values stand in ``other``: for each the place of the first value that is not smaller.

    Stretch ``i`` is ``driver[starts[i]:starts[i] + sizes[i]]``; it looks in ``other[cursor[i]:stops[i]]`` and goes on
    from where its last value was found. All values rise. Stretches advance together, one value at a time.
    """
    out = np.empty(len(driver), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, cursor, stops = starts[order], sizes[order], cursor[order].copy(), stops[order]
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        value, low, stop = driver[starts[:live] + step], cursor[:live].copy(), stops[:live]
        # doubling: low is not past the place, high is not before it
        high, wide = low.copy(), np.arange(live)
        reach = 1
        while len(wide):
            short = (high[wide] < stop[wide]) & (other[np.minimum(high[wide], len(other) - 1)] < value[wide])
            wide = wide[short]
            low[wide] = high[wide] + 1
            high[wide] = np.minimum(high[wide] + reach, stop[wide])
            reach *= 2
        # halving between the two
        wide = np.flatnonzero(low < high)
        while len(wide):
            middle = (low[wide] + high[wide]) >> 1
            short = other[middle] < value[wide]
            low[wide[short]] = middle[short] + 1
            high[wide[~short]] = middle[~short]
            wide = wide[low[wide] < high[wide]]
        out[starts[:live] + step] = low
        cursor[:live] = low
    return out


def common_ends(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have.

    Document ``i`` has the ends ``a[a_first[i]:a_first[i + 1]]`` and likewise ``b``, counted in bytes from the
    start of the first document, so all rise.
    """
    a_counts, b_counts = np.diff(a_first), np.diff(b_first)
    out_a, out_b = [], []
    for lists, firsts, counts, others, other_first, mine, theirs, picked in (
        (a, a_first, a_counts, b, b_first, out_a, out_b, a_counts <= b_counts),
        (b, b_first, b_counts, a, a_first, out_b, out_a, a_counts > b_counts),
    ):
        docs = np.flatnonzero(picked & (counts > 0))
        n = -(-counts[docs] // _STRETCH)
        doc = np.repeat(docs, n)
        starts = firsts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * _STRETCH
        sizes = np.minimum(_STRETCH, firsts[doc + 1] - starts)
        at = ranges(starts, sizes)
        found = gallop(lists, others, starts, sizes, other_first[doc], other_first[doc + 1])[at]
        same = (found < np.repeat(other_first[doc + 1], sizes)) & (others[np.minimum(found, max(len(others) - 1, 0))] == lists[at])
        mine.append(at[same])
        theirs.append(found[same])
    a_at, b_at = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(a_at, kind="stable")
    return a_at[order], b_at[order]


def _rejoined(encoder: Encoder, ids: np.ndarray) -> np.ndarray:
    return encoder.bytes[ranges(encoder.begins[ids], encoder.sizes[ids])]


def _same_bytes(encoder: Encoder, ids: np.ndarray, first: np.ndarray, segments: Segments) -> np.ndarray:
    """For every text whether its tokens' bytes joined are the text."""
    made = _rejoined(encoder, ids)
    ends = np.concatenate([[0], np.cumsum(encoder.sizes[ids])])[first]
    want = segments.offsets
    good = np.diff(ends) == np.diff(want)
    if good.all() and np.array_equal(made, segments.raw):
        return good
    for i in np.flatnonzero(good).tolist():
        good[i] = np.array_equal(made[ends[i] : ends[i + 1]], segments.raw[want[i] : want[i + 1]])
    return good


class _Aligned:
    """Tokens of the documents of a batch that have any, and their groups."""

    def __init__(self, texts: pa.Array, a: Encoder, b: Encoder):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        segments = Segments(texts, a.tokenizer.cuts and b.tokenizer.cuts)
        hashes = segments.hashes()
        both = []
        for encoder in (a, b):
            ids, first = encoder.encode(segments, hashes)
            both.append((encoder, ids, first[segments.first]))
        good = np.logical_and(*(_same_bytes(*one, segments) for one in both))
        kept = []
        for encoder, ids, first in both:
            counts = np.diff(first)
            ids = ids[np.repeat(good, counts)]
            kept.append((ids, np.concatenate([[0], np.cumsum(np.where(good, counts, 0))]), np.cumsum(encoder.sizes[ids])))
        (self.a, self.a_first, a_ends), (self.b, self.b_first, b_ends) = kept
        self.a_last, self.b_last = common_ends(a_ends, self.a_first, b_ends, self.b_first)
        self.n_a, self.n_b = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        self.group_first = np.searchsorted(self.a_last, self.a_first)

    def group_strings(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: decimal ids of every group, an empty text for no tokens."""
        n_groups = len(self.a_last)
        a_begin, b_begin = self.a_last - self.n_a + 1, self.b_last - self.n_b + 1
        side = np.tile([0, 1], n_groups)
        sizes = np.column_stack([self.n_a, self.n_b]).ravel()
        begins = np.column_stack([a_begin, b_begin + len(self.a)]).ravel()
        ids = np.concatenate([self.a, self.b])[ranges(begins, sizes)]
        digits = 1 + (ids >= 10).astype(np.int64) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000) + (ids >= 100_000) + (ids >= 1_000_000)
        after = np.full(len(ids), ord(","), np.uint8)
        after[np.cumsum(sizes) - 1] = np.where(side == 0, ord("|"), ord(";"))
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = after
        at, left = np.arange(len(ids)), ids
        for place in range(7):
            out[ends[at] - 2 - place] = ord("0") + left % 10
            more = digits[at] > place + 1
            at, left = at[more], left[more] // 10
            if not len(at):
                break
        # the semicolon after a document's last group goes
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])[self.group_first]
        stops = np.concatenate([[0], ends])[tokens]
        last = stops[1:][np.diff(self.group_first) > 0] - 1
        kept = np.ones(len(out), bool)
        kept[last] = False
        offsets = stops - np.concatenate([[0], np.cumsum(np.diff(self.group_first) > 0)])
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[kept]))

    def pairs(self, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked ids of a document as ``a << 32 | b``, and how many links each has."""
        low, high = self.group_first[doc], self.group_first[doc + 1]
        n_a, n_b = self.n_a[low:high], self.n_b[low:high]
        a_begin, b_begin = self.a_last[low:high] - n_a + 1, self.b_last[low:high] - n_b + 1
        # links of some groups at a time; a group beyond that is cut along its tokens of A
        codes, times = [], []
        load = n_a * n_b
        big = load > _LINKS
        for part in np.split(np.flatnonzero(~big), np.flatnonzero(np.diff(np.cumsum(load[~big]) // _LINKS)) + 1):
            each = np.repeat(part, n_a[part])
            a = self.a[ranges(a_begin[part], n_a[part])].astype(np.int64)
            b = self.b[ranges(b_begin[each], n_b[each])]
            _add(codes, times, (np.repeat(a, n_b[each]) << 32) | b, None)
        for group in np.flatnonzero(big).tolist():
            a, a_times = np.unique(self.a[a_begin[group] : a_begin[group] + n_a[group]], return_counts=True)
            b, b_times = np.unique(self.b[b_begin[group] : b_begin[group] + n_b[group]], return_counts=True)
            for i in range(len(a)):
                _add(codes, times, (np.int64(a[i]) << 32) | b.astype(np.int64), a_times[i] * b_times)
        if len(codes) == 1:
            return codes[0], times[0]
        return _summed(np.concatenate(codes), np.concatenate(times)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _add(codes: list, times: list, code: np.ndarray, often: np.ndarray | None) -> None:
    code, often = _summed(code, np.ones(len(code), np.int64) if often is None else often)
    codes.append(code)
    times.append(often)


def _summed(code: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, with the sum of their numbers."""
    if not len(code):
        return code, often
    order = np.argsort(code, kind="stable")
    code, often = code[order], often[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[new], np.add.reduceat(often, new)


def align_chunks(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text", chunk_pairs: int = CHUNK_PAIRS
) -> DataFrame:
    """``chunk, docs`` and the chunk's packed links: ``codes, held, sizes, place, times``.

    ``docs`` has a struct ``key, n_a, n_b, n_groups, n_links, groups`` for every document of the chunk.
    ``groups`` reads ``a1,a2|b1;a3|b2,b3``, ids in the order of the text; ``n_links`` counts the pairs of a token
    of A and one of B in the same group. ``codes`` are the distinct linked ids of the chunk (``a << 32 | b``), ``held`` says
    in how many of its documents each is linked; each document has ``sizes`` of them, at ``place``
    in that list and linked ``times`` often. All are ``pressed``, ``codes`` and ``place`` as differences. The two paths are read on the driver.

    Texts that are null or empty, and those whose tokens' bytes of either side joined are not a space and the text,
    have no tokens: zeros, and an empty ``groups``. Strings of special tokens are plain text. Every row
    is judged, also those that repeat a key or have none; other columns are left out.
    """
    context = docs.sparkSession.sparkContext
    files = []
    for name in (byte_bpe, piece_bpe):
        with open(name, "rb") as file:
            files.append(file.read())
    raw = context.broadcast(files)
    fields = [
        T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups", T.StringType()),
    ]
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(T.StructType(fields))),
        *(T.StructField(name, T.BinaryType()) for name in ("codes", "held", "sizes", "place", "times")),
    ])

    def chunk(number: int, parts: list) -> pa.RecordBatch:
        held = pa.concat_arrays([docs for docs, _ in parts])
        pairs = [pair for _, found in parts for pair in found]
        codes = np.concatenate([code for code, _ in pairs])
        distinct, place, times_held = np.unique(codes, return_inverse=True, return_counts=True)
        sizes = np.array([len(code) for code, _ in pairs], np.int32)
        # both lists rise, the second within each document: steps are short
        steps, place = np.diff(distinct, prepend=0), np.diff(place.ravel().astype(np.int32), prepend=np.int32(0))
        packed = (steps, times_held.astype(np.int32), sizes, place, np.concatenate([often for _, often in pairs]))
        rows = pa.ListArray.from_arrays(np.array([0, len(held)], np.int32), held)
        return pa.RecordBatch.from_arrays([pa.array([number]), rows, *(pa.array([pressed(x)], pa.binary()) for x in packed)], names=schema.names)

    def aligned(batches):
        a = worker_kept(("align a", hash(raw.value[0])), lambda: Encoder(ByteBpe(raw.value[0], special=False)))
        b = worker_kept(("align b", hash(raw.value[1])), lambda: Encoder(PieceBpe(raw.value[1])))
        number, waiting, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in chunks(batches, "text", _CHUNK_BYTES):
            made = _Aligned(batch.column("text"), a, b)
            links = np.concatenate([[0], np.cumsum(made.n_a * made.n_b)])[made.group_first]
            pairs = [made.pairs(doc) for doc in range(batch.num_rows)]
            columns = [
                batch.column("key"), *(pa.array(np.diff(x)) for x in (made.a_first, made.b_first, made.group_first, links)),
                made.group_strings().cast(pa.string()),
            ]
            parts.append((pa.StructArray.from_arrays(columns, names=[f.name for f in fields]), pairs))
            waiting += sum(len(code) for code, _ in pairs)
            if waiting >= chunk_pairs:
                yield chunk(number, parts)
                number, waiting, parts = number + 1, 0, []
        if parts:
            yield chunk(number, parts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(aligned, schema)


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, groups`` for every row of ``docs``, as ``align_chunks`` has them."""
    return align_chunks(docs, byte_bpe, piece_bpe, key, text).select(F.inline("docs"))


def score_links(chunked: DataFrame) -> DataFrame:
    """The documents of all chunks with ``n_best`` and ``count_sum``; their other fields may be any.

    A pair's count is the number of documents of all chunks that hold it linked; ``count_sum`` adds the counts of a
    document's links, ``n_best`` counts those links whose count is the highest of any pair with the same id of A.
    Documents without links have zeros.
    """
    fields = chunked.schema["docs"].dataType.elementType.fields

    def opened(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.cumsum(from_pressed(batch.column("codes")[i].as_py(), np.int64))
                held = from_pressed(batch.column("held")[i].as_py(), np.int32).astype(np.int64)
                number = np.full(len(codes), batch.column("chunk")[i].as_py())
                for at in range(0, len(codes), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (number, codes, held)], names=["chunk", "code", "held"])

    packed = stage(chunked, "link-chunks", rows_per_file=_FILE_CHUNKS)
    wanted = packed.select("chunk", "codes", "held").mapInArrow(opened, "chunk long, code long, held long")
    counts = stage(wanted.groupBy("code").agg(F.sum("held").alias("n")), "link-counts")
    first = F.shiftright("code", 32).alias("a")
    # a row for each id of A, so never more than that vocabulary has
    highest = counts.groupBy(first).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", first).join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    met = wanted.select("chunk", "code").join(judged, "code").select("chunk", "code", "n", "best")
    out = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = right["code"].to_numpy()
        order = np.argsort(codes, kind="stable")
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy().astype(np.int64)[order]
        left = left.combine_chunks()
        sizes, place, times = (
            from_pressed(left[name][0].as_py(), kind) for name, kind in (("sizes", np.int32), ("place", np.int32), ("times", np.int64))
        )
        place = np.cumsum(place)
        ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * worth[place])])[ends]) for worth in (best, n)]
        docs = left["docs"].combine_chunks().flatten()
        return pa.table([*docs.flatten(), *(pa.array(x) for x in sums)], names=out.names)

    return packed.drop("codes", "held").groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(summed, out)


def pressed(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed, after the length of those planes."""
    raw = packing.planes(values) if len(values) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def from_pressed(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return packing.from_planes(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)
