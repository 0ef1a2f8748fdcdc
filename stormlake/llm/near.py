"""Near-duplicate documents: banded MinHash candidates, odd sketches, confirmed links.

Every text becomes a set of word shingles, ``HASHES`` MinHash values of it, ``BANDS`` band keys,
and an odd sketch: a bitmap in which each MinHash sample flips one bit. Two bitmaps differ in about
as many bits as the samples differ, so the population count of their XOR estimates high similarities closely, at 128
bytes a document (Mitzenmacher et al. 2014). Candidates share a band; those whose sketches are far apart are
dropped with a margin of 4.5 standard errors; the rest is confirmed on the full sets.

Copies are one row from the start (equal sets have equal digests). Within a band no list of all pairs is
made: first every member meets the smallest member only. Where the confirmed links have not
joined a band's members into one component, those outside its largest component meet a few members of it, picked by
hash. Who is still outside then meets the others in two ways. A shingle that few of these members have is rare: an outsider meets all
that share a rare one, at most ``RARE`` for each. Two members that share no rare one can only have common ones in common. These are counted
within and beyond the set of one member of the band, its center: of either part two sets share no more than the smaller count. Members of the
same size and counts beyond the center are a class; an outsider meets the classes of its bands, and the members only of a class whose
counts allow the similarity. Pairs left get a finer sketch of four times the samples and bits, so half the standard error and half the margin.
A pair that is skipped is one that is already connected, or one whose counts rule the similarity out, so components are whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.components import connected_components, extended_components
from stormlake.llm.words import Words, chunks, mixed, window_hashes
from stormlake.session import stage

#: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**40, about 1e-7
BANDS, ROWS = 40, 5
#: MinHash values; the bands use the first of them, the sketch all
HASHES = 2 * BANDS * ROWS
SKETCH_BITS = 1024
#: sketch estimates may fall short of the threshold by this much: 4.5 standard errors
MARGIN = 0.12
#: the finer sketch has so many times the samples and bits
FINER = 4
#: members of a band's largest component that each outsider meets before it meets all
HUBS = 6
#: a shingle is rare if at most so many of the members that have yet to meet have it
RARE = 64
#: common shingles beyond a band's center are counted in so many parts
PARTS = 8
_CHUNK = 1 << 20
#: sets signed at once, which bounds the table of their samples
_BLOCK = 1024


def _hash_numbers(count: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20140405)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the distinct ``n``-word shingles of each text, lower-cased, as sorted hashes.

    A text of fewer words, but not none, has its whole word sequence as its one shingle.
    """
    words = Words(texts, "spaced", lower=True)
    hashes, counts = words.hashes(), words.counts()
    row = words.row_of_word()
    windows = window_hashes(hashes, n)
    inside = np.flatnonzero(np.arange(len(windows)) + n <= words.first[1:][row[: len(windows)]]) if len(windows) else np.zeros(0, np.int64)
    rows, values = [row[inside]], [windows[inside]]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            with np.errstate(over="ignore"):
                value = np.full(len(short), size, dtype=np.uint64)
                for k in range(size):
                    value = mixed(value + hashes[words.first[short] + k])
            rows.append(short)
            values.append(value)
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[fresh], values[fresh]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def _samples(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of non-empty sets, a column each."""
    small = (values >> np.uint64(32)).astype(np.uint32)
    lows = np.empty((len(a), len(first) - 1), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(len(a)):
            lows[i] = np.minimum.reduceat(small * a[i] + b[i], first[:-1])
    return lows


def _odd_sketches(lows: np.ndarray, n_bits: int) -> np.ndarray:
    """Every sample of a set flips one bit of its bitmap."""
    n = lows.shape[1]
    with np.errstate(over="ignore"):
        spots = mixed(lows.astype(np.uint64) + (np.arange(len(lows), dtype=np.uint64)[:, None] << np.uint64(33))) % np.uint64(n_bits)
    flat = (np.arange(n, dtype=np.int64)[None, :] * n_bits + spots.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * n_bits) & 1).astype(np.uint8).reshape(n, n_bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _band_keys(lows: np.ndarray) -> np.ndarray:
    bands = np.empty((lows.shape[1], BANDS), dtype=np.int64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(lows.shape[1], band + 1, dtype=np.uint64)
            for i in range(band * ROWS, (band + 1) * ROWS):
                key = mixed(key + lows[i])
            bands[:, band] = key.view(np.int64)
    return bands


def _blocks(values: np.ndarray, first: np.ndarray):
    """Values and bounds of at most ``_BLOCK`` sets at a time."""
    for at in range(0, len(first) - 1, _BLOCK):
        bounds = first[at : at + _BLOCK + 1]
        yield values[bounds[0] : bounds[-1]], bounds - bounds[0]


def _signatures(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty sets, a row each."""
    lows = [_samples(*block, a, b) for block in _blocks(values, first)]
    return np.concatenate([_band_keys(x) for x in lows]), np.concatenate([_odd_sketches(x, SKETCH_BITS) for x in lows])


def fine_sketches(texts: DataFrame, n: int) -> DataFrame:
    """``node, sketch, fine`` of every text that has a word; ``fine`` has ``FINER`` times the samples and bits."""
    n_bits = FINER * SKETCH_BITS

    def sketched(batches):
        a, b = _hash_numbers(FINER * HASHES)
        for batch in chunks(batches, "text", _CHUNK):
            values, first = shingle_sets(batch.column("text"), n)
            full = np.flatnonzero(np.diff(first))
            for at in range(0, len(full), _BLOCK):
                rows = full[at : at + _BLOCK]
                bounds = np.append(first[rows], first[rows[-1] + 1])
                lows = _samples(values[bounds[0] : bounds[-1]], bounds - bounds[0], a, b)
                sketches = [_odd_sketches(lows[:HASHES], SKETCH_BITS), _odd_sketches(lows, n_bits)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in sketches]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), *lists], names=["node", "sketch", "fine"])

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInArrow(sketched, f"node {kind}, sketch array<bigint>, fine array<bigint>")


def shingle_rows(texts: DataFrame, n: int) -> DataFrame:
    """``node, size, shingle``: a row for each distinct shingle of every text, with their number."""

    def listed(batches):
        for batch in chunks(batches, "text", _CHUNK):
            values, first = shingle_sets(batch.column("text"), n)
            sizes = np.diff(first)
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(row)), pa.array(sizes[row], pa.int64()), pa.array(values.view(np.int64))],
                names=["node", "size", "shingle"],
            )

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInArrow(listed, f"node {kind}, size bigint, shingle bigint")


def furthest(threshold: float, finer: int = 1) -> int:
    """Most differing sketch bits of a pair that is still confirmed on its sets."""
    hashes, n_bits = finer * HASHES, finer * SKETCH_BITS
    differing = hashes * (1 - max(0.0, threshold - MARGIN / math.sqrt(finer)))
    return math.ceil(n_bits / 2 * (1 - math.exp(-4 * differing / n_bits)))


def sign(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, n_shingles, d1, d2, bands, sketch`` for every row; digests and bands are null for an empty set."""
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def signed(batches):
        a, b = _hash_numbers()
        for batch in chunks(batches, "text", _CHUNK):
            values, first = shingle_sets(batch.column("text"), n)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            starts = np.append(first[full], len(values))
            d1 = d2 = np.zeros(0, np.int64)
            bands, sketch = np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_BITS // 64), np.int64)
            if len(full):
                with np.errstate(over="ignore"):
                    d1 = np.add.reduceat(mixed(values), starts[:-1]).view(np.int64)
                    d2 = np.add.reduceat(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1]).view(np.int64)
                bands, sketch = _signatures(values, starts, a, b)
            back = np.full(len(sizes), -1)
            back[full] = np.arange(len(full))
            take = pa.array(back, mask=back < 0)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())).take(take)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(d1).take(take), pa.array(d2).take(take), lists(bands), lists(sketch)],
                names=schema.names,
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(signed, schema)


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have ``100 * both >= percent * either``."""

    def confirmed(batches):
        for batch in batches:
            for sized in chunks([batch], "text_a", _CHUNK):
                for part in chunks([sized], "text_b", _CHUNK):
                    sets = [shingle_sets(part.column(c), n) for c in ("text_a", "text_b")]
                    rows = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(first)) for _, first in sets])
                    values = np.concatenate([v for v, _ in sets])
                    order = np.lexsort((values, rows))
                    same = (rows[order][1:] == rows[order][:-1]) & (values[order][1:] == values[order][:-1])
                    both = np.bincount(rows[order][1:][same], minlength=part.num_rows)
                    either = np.diff(sets[0][1]) + np.diff(sets[1][1]) - both
                    linked = np.flatnonzero((100 * both >= percent * either) & (both > 0))
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(linked)) for c in ("a", "b")], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirmed, f"a {kind}, b {kind}")


def _apart(one: str, other: str):
    """Population count of the XOR of two sketches."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i]))
    return total


def _fine_apart(one: str, other: str):
    """The same of two fine sketches; so many terms written out would be too long a method for the JIT compiler."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _unjoined(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, node, root, largest`` of the bands whose members are in several components."""
    rooted = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "near-rooted")
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("size"))
    several = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("parts"))
    return stage(rooted.join(several.where(F.col("parts") > 1).select("band", "largest"), "band"), "near-unjoined")


def _may_link(both: Column, percent: int) -> Column:
    """Whether sets of ``size_x`` and ``size_y`` with at most ``both`` shingles in common may be linked."""
    return (100 + percent) * both >= percent * (F.col("size_x") + F.col("size_y"))


def _rare_and_common(rest: DataFrame, shingles: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``node, root, out, size, shingle, place`` of rare shingles, and ``node, size, common, shingles``: the others of a member and their number.

    Only shingles count that an outsider and someone else have; ``out`` says that the node is outside in one of its bands. Every set is
    put in one order, the rarest first: linked sets have the first shingle in common among the first fifth of each (at 80 percent),
    so rows of later places are left out.
    """
    nodes = rest.groupBy("node", "root").agg(F.max(F.col("root") != F.col("largest")).alias("out"))
    rows = shingles.join(nodes, "node").repartition("shingle")
    held_by = rows.groupBy("shingle").agg(F.count("*").alias("holders"), F.max("out").alias("some_out"))
    held = stage(rows.join(held_by.where(F.col("some_out") & (F.col("holders") > 1)), "shingle"), "near-held")
    of_set = Window.partitionBy("node", "size")
    place = F.col("size") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("holders", "shingle"))
    placed = held.withColumn("place", place).where(100 * F.col("place") <= (100 - percent) * F.col("size") + 100)
    rare = placed.where(F.col("holders") <= RARE).select("node", "root", "out", "size", "shingle", "place")
    common = held.where(F.col("holders") > RARE).groupBy("node", "size").agg(F.count("*").alias("common"), F.collect_list("shingle").alias("shingles"))
    return rare, stage(common, "near-common")


def _sharing_rare(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of an outsider and another component's member that share a rare shingle and may be linked, once for each such shingle."""
    columns = ("node", "root", "out", "size", "place")
    x = rare.where("out").select("shingle", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = rare.select("shingle", *(F.col(c).alias(f"{c}_y") for c in columns))
    # the shingle itself and those behind it
    both = 1 + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    return (
        x.join(y, "shingle")
        .where((F.col("root_x") != F.col("root_y")) & (~F.col("out_y") | (F.col("node_x") < F.col("node_y"))))
        .where(_may_link(both, percent))
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    )


def _around_centers(rest: DataFrame, plain: DataFrame) -> DataFrame:
    """``band, node, root, largest, size, inside, beyond`` of the members of bands that have outsiders.

    ``inside`` is the number of common shingles that a member shares with its band's center, ``beyond`` that of its others, in ``PARTS`` parts.
    The center is the member of the largest component that has most common shingles, so that little of the others is beyond it.
    """
    rest = stage(rest.join(plain.select("node", "size", "common"), "node"), "near-rest")
    joined = F.col("root") == F.col("largest")
    centers = (
        rest.groupBy("band").agg(F.max(F.struct(joined.alias("joined"), "common", "node", "size")).alias("center"), F.max(~joined).alias("some_out"), F.count("*").alias("met"))
        .where(F.col("some_out") & (F.col("met") > 1)).select("band", F.col("center.node").alias("center"), F.col("center.size").alias("center_size"))
    )
    rest = rest.drop("common").join(centers, "band")
    of_center = plain.select(F.col("node").alias("center"), F.col("size").alias("center_size"), F.col("shingles").alias("center_shingles"))
    around = (
        rest.select("node", "size", "center", "center_size").distinct()
        .join(of_center, ["center", "center_size"]).join(plain.select("node", "size", "shingles"), ["node", "size"])
        .withColumn("others", F.array_except("shingles", "center_shingles"))
        .withColumn("inside", F.size(F.array_intersect("shingles", "center_shingles")))
        .withColumn("beyond", F.array(*(F.size(F.filter("others", _in_part(i))) for i in range(PARTS))))
        .select("node", "size", "center", "center_size", "inside", "beyond")
    )
    rest = rest.join(around, ["node", "size", "center", "center_size"])
    return stage(rest.select("band", "node", "root", "largest", "size", "inside", "beyond"), "near-around")


def _in_part(i: int):
    return lambda shingle: F.pmod(shingle, F.lit(PARTS)) == i


def _sharing_common(rest: DataFrame, plain: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of an outsider and another component's member of its band that may be linked by common shingles alone."""
    rest = _around_centers(rest, plain)
    columns = ("node", "root", "size", "inside", "beyond")
    one = rest.where(F.col("root") != F.col("largest")).select("band", "largest", *(F.col(c).alias(f"{c}_x") for c in columns))
    other = rest.select("band", *(F.col(c).alias(f"{c}_y") for c in columns))
    classes = other.groupBy("band", "size_y", "beyond_y").agg(F.max("inside_y").alias("inside_y"))
    both = F.least("inside_x", "inside_y")
    for i in range(PARTS):
        both = both + F.least(F.col("beyond_x")[i], F.col("beyond_y")[i])
    return (
        one.join(classes, "band").where(_may_link(both, percent)).drop("inside_y")
        .join(other, ["band", "size_y", "beyond_y"]).where(_may_link(both, percent))
        # two outsiders meet once, an outsider meets each member of the largest component
        .where((F.col("root_x") < F.col("root_y")) | ((F.col("root_x") > F.col("root_y")) & (F.col("root_y") == F.col("largest"))))
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Texts are linked when their sets of lower-cased ``n``-word shingles have a Jaccard similarity of at least ``percent`` percent;
    ``component_id`` is the smallest key that links reach, ``kept`` says that it is the row's own.
    A text shorter than ``n`` words has its whole word sequence as its only shingle. A null or
    empty text, or one of white space, is linked with nothing and kept. Rows that repeat a key belong
    to one component, whatever their texts. A row without a key takes no part: its component is
    null and it is kept. Columns besides key and text are left out.
    """
    signed = stage(sign(docs, key, text, n), "near-signatures")
    full = signed.where(F.col("d1").isNotNull() & F.col("key").isNotNull())
    sets = stage(
        full.groupBy("d1", "d2").agg(F.min("key").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "near-sets",
    )
    owner = full.select("key", "d1", "d2").join(sets.select("d1", "d2", "node"), ["d1", "d2"])
    # rows that repeat a key: all its sets belong together
    repeated = owner.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") != F.col("high"))
    repeated = owner.join(repeated.select("key", "low"), "key").select(F.col("node").alias("a"), F.col("low").alias("b"))

    banded = sets.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where(F.col("hub") != F.col("last")).select("band", "hub")
    members = stage(banded.join(hubs, "band").distinct(), "near-bands")

    sketches = sets.select("node", "sketch")
    limit = furthest(percent / 100)

    def alike(pairs: DataFrame) -> DataFrame:
        """Distinct pairs ``a, b`` whose sketches are close enough."""
        return (
            pairs.distinct()
            .join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
            .where(_apart("sketch_a", "sketch_b") <= limit)
            .select("a", "b")
            .distinct()
        )

    needed = members.select(F.col("node").alias("key")).distinct()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(needed, "key", "left_semi")
    texts = stage(texts.where(F.col("text").isNotNull()).select(F.col("key").alias("node"), "text").distinct(), "near-texts")

    stars = members.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    roots = connected_components(confirm(alike(stars), texts, n, percent).unionByName(repeated), "a", "b")

    rest = _unjoined(members, roots)
    inside = rest.where(F.col("root") == F.col("largest"))
    picked = inside.groupBy("band").agg(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HUBS))).alias("hubs"))
    met = (
        rest.where(F.col("root") != F.col("largest")).join(picked, "band")
        .select(F.col("node").alias("b"), F.explode(F.array_distinct("hubs")).alias("a"))
    )
    roots = extended_components(roots, confirm(alike(met), texts, n, percent), "a", "b")

    rest = _unjoined(members, roots)
    left = texts.join(rest.select("node").distinct(), "node", "left_semi")
    rare, common = _rare_and_common(rest, shingle_rows(left, n), percent)
    found = _sharing_rare(rare, percent)
    # without a rare shingle in common, only sets that are common for the most part can be alike
    plain = stage(common.where(100 * F.col("common") >= percent * F.col("size")), "near-plain")
    fine = stage(fine_sketches(left.join(plain.select("node").distinct(), "node", "left_semi"), n), "near-fine")
    crossed = (
        _sharing_common(rest, plain, percent)
        .join(fine.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("fine").alias("fine_a")), "a")
        .join(fine.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("fine").alias("fine_b")), "b")
        # most pairs end at the short sketch
        .where((_apart("sketch_a", "sketch_b") <= limit) & (_fine_apart("fine_a", "fine_b") <= furthest(percent / 100, FINER)))
        .select("a", "b")
    )
    crossed = crossed.unionByName(found).distinct()
    final = extended_components(roots, confirm(crossed, texts, n, percent), "a", "b")

    found = (
        signed.select("key", "n_shingles", "d1", "d2")
        .join(sets.select("d1", "d2", "node"), ["d1", "d2"], "left")
        .join(final, "node", "left")
    )
    component = F.when(F.col("key").isNotNull(), F.coalesce("root", "node", "key"))
    return found.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )
