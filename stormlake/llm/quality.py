"""Quality by ordinal cumulative-link regression on hashed text.

Ratings are ordered grades 0..G. One weight per hashed feature is shared by all grades;
grade thresholds t_1 < ... < t_G turn the score s(x) = w.x into
P(grade >= g) = sigmoid(s(x) - t_g). Selection is by the tail probability of a grade.

Features are the distinct lower-cased words of a text, the shapes of its words (letters,
capitals, digits and other characters as classes, runs folded) and the logarithm of
their share, all hashed to one table. So both a single telling word and the general look of a text
count, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.words import Words, chunks, mixed

#: most labelled texts that a fit reads; those with the smallest hash of their id
SAMPLE = 20_000
#: most text that a fit reads, in features of all sampled texts together
BITS = 18
EPOCHS = 12
SEED = 7
KEEP_FROM = 0.5
_CHUNK = 2 << 20
#: shapes are counted in so many steps of the logarithm of their share
_SHARE_STEPS = 6


def _shape_classes() -> np.ndarray:
    """Class of each byte: 1 lower-case letter or any non-ASCII byte, 2 capital, 3 digit,
    4 and above one for each mark."""
    out = np.arange(256, dtype=np.uint64)
    out[97:123] = 1
    out[128:] = 1
    out[65:91] = 2
    out[48:58] = 3
    return out


_SHAPES = _shape_classes()


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(index, first)``: sorted distinct hashed features of text i are ``index[first[i]:first[i + 1]]``.

    A null or empty text has none.
    """
    words = Words(texts, "spaced", lower=True)
    rows = words.row_of_word().astype(np.uint64)
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    mask = np.uint64((1 << bits) - 1)
    inner = Words(texts, "plain", lower=True)
    parts = [
        (inner.row_of_word().astype(np.uint64), inner.hashes() & mask),
    ]
    # the shape of a word: its first two and last three characters' classes, and whether long
    length = words.end - words.start
    shape = np.minimum(length, 3).astype(np.uint64)
    with np.errstate(over="ignore"):
        for at in (words.start, np.minimum(words.start + 1, words.end - 1), np.maximum(words.end - 3, words.start), np.maximum(words.end - 2, words.start), words.end - 1):
            shape = shape * np.uint64(1_000_003) + _SHAPES[words.raw[at]]
    shape = mixed(shape)
    # share of each shape in its text, in steps of its logarithm
    pairs = mixed(rows) ^ shape
    _, at, back, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
    total = words.counts()[rows[at].astype(np.int64)]
    step = np.minimum(np.floor(-np.log2(count / total)), _SHARE_STEPS).astype(np.uint64)
    with np.errstate(over="ignore"):
        parts.append((rows[at], mixed(shape[at] * np.uint64(31) + step + np.uint64(1)) & mask))
    keys = np.unique(np.concatenate([(r << np.uint64(bits)) | f for r, f in parts]))
    owner = (keys >> np.uint64(bits)).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return (keys & mask).astype(np.int64), first


class OrdinalModel:
    """Shared weights and ordered thresholds; plain arrays, ``4 * 2**bits`` bytes."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def scores(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1..G, a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(
    index: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS,
    epochs: int = EPOCHS, seed: int = SEED,
) -> OrdinalModel:
    """Adagrad on the log-likelihood of the observed grades, one sample at a time in small batches.

    Without samples all weights are 0 and every tail is 0.5 or more, so nothing is rejected.
    """
    weights = np.zeros(1 << bits, dtype=np.float64)
    thresholds = np.zeros(n_grades - 1, dtype=np.float64)
    n = len(grades)
    if not n:
        return OrdinalModel(weights.astype(np.float32), thresholds, bits)
    for g in range(1, n_grades):
        share = (np.sum(grades >= g) + 0.5) / (n + 1)
        thresholds[g - 1] = -np.log(share / (1 - share))
    thresholds = np.maximum.accumulate(thresholds)
    squares, t_squares = np.full(1 << bits, 1e-6), np.full(n_grades - 1, 1.0)
    rng = np.random.default_rng(seed)
    lengths = np.diff(first)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for batch in np.array_split(rng.permutation(n), max(1, n // 32)):
            spans = lengths[batch]
            at = np.repeat(first[batch] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            features_, owner = index[at], np.repeat(np.arange(len(batch)), spans)
            scale = 1 / np.sqrt(np.maximum(spans, 1))
            s = np.bincount(owner, weights[features_], minlength=len(batch))
            y = grades[batch]
            # P(y) = F(s - t_y) - F(s - t_{y+1}), with F(s - t_0) = 1 and F(s - t_{G+1}) = 0
            low = np.where(y > 0, sigmoid(s - thresholds[np.maximum(y - 1, 0)]), 1.0)
            high = np.where(y < n_grades - 1, sigmoid(s - thresholds[np.minimum(y, n_grades - 2)]), 0.0)
            d_low = np.where(y > 0, low * (1 - low), 0.0)
            d_high = np.where(y < n_grades - 1, high * (1 - high), 0.0)
            p = np.maximum(low - high, 1e-9)
            gradient = -(d_low - d_high) / p
            step = np.bincount(features_, (gradient * scale)[owner], minlength=0)
            used = np.flatnonzero(step)
            squares[used] += step[used] ** 2
            weights[used] -= rate * step[used] / np.sqrt(squares[used])
            t_step = np.zeros(n_grades - 1)
            np.add.at(t_step, np.maximum(y - 1, 0), np.where(y > 0, d_low / p, 0.0))
            np.add.at(t_step, np.minimum(y, n_grades - 2), np.where(y < n_grades - 1, -d_high / p, 0.0))
            t_squares += t_step**2
            thresholds = np.maximum.accumulate(thresholds - rate * t_step / np.sqrt(t_squares) * 0.1)
    return OrdinalModel(weights.astype(np.float32), thresholds, bits)


def fit_quality(
    docs: DataFrame, ratings: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text",
    grade: str = "grade", sample: int = SAMPLE, bits: int = BITS,
) -> OrdinalModel:
    """Fit on at most ``sample`` rated texts: those whose key has the smallest hash.

    ``ratings`` has ``key`` and an integer ``grade`` from 0 to ``n_grades - 1``; rows with a null key or
    grade, or one out of range, are left out, and several ratings of one key count as their
    lowest. Only hashed features of the sample reach the driver, some kilobytes a text.
    """
    rated = (
        ratings.where(F.col(key).isNotNull() & F.col(grade).between(0, n_grades - 1))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(grade).cast("int").alias("_grade"))
        .orderBy(F.xxhash64(F.col("_key").cast("string")), "_key")
        .limit(sample)
    )
    rated_docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rated), "_key")

    def hashed(batches):
        for batch in chunks(batches, "_text", _CHUNK):
            index, first = features(batch.column("_text"), bits)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").cast(pa.string()), batch.column("_grade"), lists], names=["key", "grade", "features"]
            )

    table = (
        rated_docs.mapInArrow(hashed, "key string, grade int, features array<int>")
        .dropDuplicates(["key"])
        .toArrow()
        .sort_by("key")
    )
    if not table.num_rows:
        return fit_ordinal(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), n_grades, bits)
    lists = table.column("features").combine_chunks()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    index = lists.flatten().to_numpy().astype(np.int64)
    return fit_ordinal(index, first, table.column("grade").to_numpy().astype(np.int64), n_grades, bits)


def rate_quality(docs: DataFrame, model: OrdinalModel, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with ``quality_grade`` (expected grade), ``quality_tail`` (probability of the
    highest grade) and ``quality_kept`` (tail of at least ``keep_from``).

    One pass without a shuffle. A null or empty text, or one of white space, has no evidence:
    its score is 0 and it is judged by the thresholds alone. Columns of the input that have
    one of the three names are replaced; every other column and each repeated row stays.
    """
    names = ["quality_grade", "quality_tail", "quality_kept"]
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))

    def rated(batches):
        weights, thresholds, bits = shared.value
        local = OrdinalModel(weights, thresholds, bits)
        for batch in chunks(batches, text, _CHUNK):
            tails = local.tails(local.scores(*features(batch.column(text), bits)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_from)],
                names=schema.names,
            )

    return docs.select(*kept).mapInArrow(rated, schema)
