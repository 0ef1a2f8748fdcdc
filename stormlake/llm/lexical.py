"""Ranked lexical search of items in documents, by two trees that are walked together.

``search_ranked`` reads the documents once for the terms that the items hold and writes them in
shards: per shard its documents, their lengths, and the postings of those terms. Document frequencies, the
number of documents and their lengths are summed over all shards. Then every shard becomes a
tree whose nodes hold, for each term, the largest weight of the documents below; items form
such trees too, in batches. The product of two nodes is an upper bound for every
pair below them. Where it is under the worst kth score of the node's items, all these pairs are left out,
which is exact; pairs of leaves are scores. A task carries its kth scores from shard to
shard, and starts from those that an opening search of one shard in ``OPENING`` has found.

Nothing but the best rows of each task is shuffled. A task holds one shard, one batch's matrix of at most
``BATCH_CELLS`` numbers (or one item's), and k rows per item of a block. Items come in blocks of about
``BLOCK_TERMS`` terms; only a block is broadcast (some 20 bytes a term), and each block
reads the documents once. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.tokens import ranges
from stormlake.llm.words import Words, chunks
from stormlake.session import stage

SHARD_BYTES = 8 << 20
#: distinct terms of items, summed over the items, that are searched at a time
BLOCK_TERMS = 2_000_000
#: items times distinct terms of one batch of items
BATCH_CELLS = 1 << 21
#: one shard in so many is searched first
OPENING = 16
FAN_ITEMS, FAN_DOCS = 4, 8
#: products that are summed at a time
_PRODUCTS = 1 << 21


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, terms, counts``: the distinct term hashes of every row of ``items``; rows without terms are left out."""
    schema = T.StructType([
        T.StructField("item", items.schema[key].dataType), T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def cut(batches):
        for batch in chunks(batches, "text", 1 << 20):
            words = Words(batch.column("text"), "plain", lower=True)
            row, term, count = _counted(words)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int64())) for x in (term.view(np.int64), count)]
            made = pa.RecordBatch.from_arrays([batch.column("item"), *lists], names=schema.names)
            yield made.filter(pa.array(np.diff(first) > 0))

    return items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def _counted(words: Words, hashes: np.ndarray | None = None, row: np.ndarray | None = None):
    """``row, term, count`` of the words, sorted by row and term."""
    hashes = words.hashes() if hashes is None else hashes
    row = words.row_of_word() if row is None else row
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], hashes[new], np.diff(np.append(new, len(row)))


def build_shards(docs: DataFrame, vocabulary, key: str, text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: ``shard, keys, n_terms, n_docs, total, doc, term, often``.

    ``vocabulary`` is a broadcast sorted array of term hashes; ``term`` numbers it. ``n_docs`` and ``total`` count
    the shard's documents with terms and all their terms; ``keys`` and ``n_terms`` are those
    of the documents that hold a term of the vocabulary, ``doc`` numbers them.
    """
    numbers = [T.StructField(name, T.LongType()) for name in ("n_docs", "total")]
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
        T.StructField("n_terms", T.BinaryType()), *numbers,
        *(T.StructField(name, T.BinaryType()) for name in ("doc", "term", "often")),
    ])

    def indexed(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        known = vocabulary.value
        for batch in chunks(batches, "text", shard_bytes):
            words = Words(batch.column("text"), "plain", lower=True)
            counts = words.counts()
            hashes, row = words.hashes(), words.row_of_word()
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            mine = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            row, term, often = _counted(words, at[mine], row[mine])
            kept, doc = np.unique(row, return_inverse=True)
            keys = batch.column("key").take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made]), pa.ListArray.from_arrays(np.array([0, len(keys)], np.int32), keys),
                    pa.array([counts[kept].astype(np.int64).tobytes()]), pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())]),
                    pa.array([doc.astype(np.int32).tobytes()]), pa.array([term.astype(np.int32).tobytes()]),
                    pa.array([often.astype(np.int32).tobytes()]),
                ],
                names=schema.names,
            )
            made += 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(indexed, schema), "lexical-index")


def document_frequencies(shards: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; summed in the tasks first."""

    def summed(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for raw in batch.column("term").to_pylist():
                total += np.bincount(np.frombuffer(raw, np.int32), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    rows = shards.select("term").mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


class Batch:
    """Some items as a tree: ``levels[0]`` has a row per item, the last one a single row, over the batch's terms."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.items = numbers
        spans = first[numbers + 1] - first[numbers]
        at = ranges(first[numbers], spans)
        self.terms, local = np.unique(terms[at], return_inverse=True)
        leaves = np.zeros((len(numbers), len(self.terms)), np.int64)
        leaves[np.repeat(np.arange(len(numbers)), spans), local] = weights[at]
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN_ITEMS), axis=0))

    def worst(self, floor: np.ndarray) -> list[np.ndarray]:
        """The least floor of the items below each node."""
        out = [floor[self.items]]
        for level in self.levels[1:]:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN_ITEMS)))
        return out


def item_batches(first: np.ndarray, terms: np.ndarray, weights: np.ndarray, cells: int = BATCH_CELLS) -> list[np.ndarray]:
    """Items that share their heaviest terms stand together, as many as fit ``cells`` items times terms."""
    n = len(first) - 1
    item = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((terms, -weights, item))
    heaviest = terms[order][first[:-1]]
    out, now, held = [], [], 0
    for i in np.lexsort((np.arange(n), heaviest)).tolist():
        more = int(first[i + 1] - first[i])
        if now and (len(now) + 1) * (held + more) > cells:
            out.append(np.array(now))
            now, held = [], 0
        now.append(i)
        held += more
    return [*out, np.array(now)] if now else out


class ShardTree:
    """Documents of a shard as a tree: in each level rows of sorted terms with their largest weight."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray):
        docs, inner = np.unique(doc, return_inverse=True)
        # documents with the same heaviest term stand together
        order = np.lexsort((term, -weight, inner))
        heads = np.searchsorted(inner[order], np.arange(len(docs)))
        by = np.argsort(term[order][heads], kind="stable")
        place = np.empty(len(docs), np.int64)
        place[by] = np.arange(len(docs))
        self.docs = docs[by]
        node = place[inner]
        order = np.lexsort((term, node))
        self.levels = [self._rows(node[order], term[order], value[order], len(docs))]
        while len(self.levels[-1][0]) > 2:
            first, term, value = self.levels[-1]
            node = np.repeat(np.arange(len(first) - 1), np.diff(first)) // FAN_DOCS
            order = np.lexsort((term, node))
            node, term, value = node[order], term[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])]))
            self.levels.append(self._rows(node[new], term[new], np.maximum.reduceat(value, new), int(node[-1]) + 1))

    @staticmethod
    def _rows(node, term, value, n):
        return np.searchsorted(node, np.arange(n + 1)), term, value


def bounds(rows: np.ndarray, q: np.ndarray, level, d: np.ndarray) -> np.ndarray:
    """The product of item node ``q[i]`` and document node ``d[i]``."""
    first, term, value = level
    counts = first[d + 1] - first[d]
    out = np.empty(len(d), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // _PRODUCTS)) + 1
    for part in np.split(np.arange(len(d)), cuts):
        at = ranges(first[d[part]], counts[part])
        products = rows[np.repeat(q[part], counts[part]), term[at]] * value[at]
        out[part] = np.add.reduceat(products, np.cumsum(counts[part]) - counts[part])
    return out


def walk(batch: Batch, tree: ShardTree, floor, found) -> int:
    """Hand all pairs that may be among the best to ``found(item, doc, score)``; how many products were taken.

    ``floor(items)`` gives each item's least score of use, which may rise between calls.
    """
    taken = 0
    a, b = len(batch.levels) - 1, len(tree.levels) - 1
    start = np.arange(len(tree.levels[b][0]) - 1)
    if b and len(start) == 1:
        b -= 1
        start = np.arange(len(tree.levels[b][0]) - 1)
    top = bounds(batch.levels[a], np.zeros(len(start), np.int64), tree.levels[b], start)
    taken += len(start)
    for node in start[np.argsort(-top, kind="stable")].tolist():
        worst = batch.worst(floor())
        q, d, i, j = np.zeros(1, np.int64), np.array([node]), a, b
        score = top[d]
        while True:
            good = score >= worst[i][q]
            q, d, score = q[good], d[good], score[good]
            if not len(q) or not (i or j):
                break
            # the side with more levels left opens first
            if i >= j:
                i -= 1
                n = np.minimum(FAN_ITEMS, len(batch.levels[i]) - q * FAN_ITEMS)
                q, d = ranges(q * FAN_ITEMS, n), np.repeat(d, n)
            else:
                j -= 1
                n = np.minimum(FAN_DOCS, len(tree.levels[j][0]) - 1 - d * FAN_DOCS)
                d, q = ranges(d * FAN_DOCS, n), np.repeat(q, n)
            score = bounds(batch.levels[i], q, tree.levels[j], d)
            taken += len(q)
        if len(q):
            found(batch.items[q], tree.docs[d], score)
    return taken


class Best:
    """The k best rows of every item so far, ties by key; ``floor`` is the least score that may still enter."""

    def __init__(self, k: int, floor: np.ndarray, kind):
        self.k, self.floor = k, floor.copy()
        self.rows = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "key": pa.array([], kind)})
        self.new, self.waiting = [], 0

    def add(self, item: np.ndarray, keys: pa.Array, score: np.ndarray) -> None:
        self.new.append(pa.table({"item": pa.array(item), "score": pa.array(score), "key": keys}))
        self.waiting += len(item)
        if self.waiting > len(self.floor):
            self.settle()

    def settle(self) -> None:
        rows = pa.concat_tables([self.rows, *self.new]).combine_chunks()
        rows = rows.sort_by([("item", "ascending"), ("score", "descending"), ("key", "ascending")])
        item = rows["item"].to_numpy()
        heads = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
        full = np.flatnonzero(rank == self.k - 1)
        self.floor[item[full]] = np.maximum(self.floor[item[full]], rows["score"].to_numpy()[full])
        self.rows = rows.filter(pa.array(rank < self.k))
        self.new, self.waiting = [], 0


def length_norms(n_terms: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``25 + (75 * n * N) div L``, also where the product is over 64 bits."""
    if len(n_terms) and 75 * int(n_terms.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(n) * n_docs // total for n in n_terms], np.int64)
    return 25 + 75 * n_terms * n_docs // max(total, 1)


def search_ranked(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES,
    opening: int = OPENING, batch_cells: int = BATCH_CELLS,
) -> DataFrame:
    """``item_key, rank, key, score``: the ``k`` best documents of every row of ``items``, scores above 0 only.

    Terms are runs of ASCII digits, letters (A-Z as a-z) and non-ASCII characters of whole texts. A term's
    weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, N the documents with a term; a document
    scores ``w * ((10^9 tf) div (1000 tf + 8 m))`` for each term of the item, repeats included, with
    ``m = 25 + (75 n N) div L``. Equal scores go by ascending key, a null key last.

    Null and empty texts have no terms: such documents do not count, such items have no rows. Every
    row is a document or an item of its own, also those that repeat a key or have none. Other
    columns are left out.
    """
    rows = stage(item_terms(items, item_key, item_text), "item-terms")
    n_entries = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-n_entries // block_terms))
    block = F.pmod(F.xxhash64("item", "terms"), F.lit(n_blocks))
    found = None
    for number in range(n_blocks):
        part = _search_block(docs, rows.where(block == number), key, text, k, shard_bytes, opening, batch_cells)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _search_block(docs, items, key, text, k, shard_bytes, opening, batch_cells) -> DataFrame:
    context = docs.sparkSession.sparkContext
    held = items.orderBy("item", "terms").toArrow().combine_chunks()
    first = np.concatenate([[0], np.cumsum(held["terms"].combine_chunks().value_lengths().to_numpy())]).astype(np.int64)
    hashes = held["terms"].combine_chunks().flatten().to_numpy().view(np.uint64)
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    shards = build_shards(docs, context.broadcast(vocabulary), key, text, shard_bytes)
    n_docs, total = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("total")).first())
    often = document_frequencies(shards, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in often.tolist()], np.int64)
    weights = weight[terms] * held["counts"].combine_chunks().flatten().to_numpy()
    shared = context.broadcast((first, terms, weights, weight, item_batches(first, terms, weights, batch_cells), held["item"].combine_chunks()))
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("key", kind),
        T.StructField("name", items.schema["item"].dataType),
    ])

    def searched(floor):
        def run(batches):
            first, terms, weights, weight, numbers, names = shared.value
            best, trees = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    keys = batch.column("keys")[i].values
                    best = best or Best(k, floor.value, keys.type)
                    norm = length_norms(np.frombuffer(batch.column("n_terms")[i].as_py(), np.int64), n_docs, total)
                    doc, term, tf = (np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in ("doc", "term", "often"))
                    value = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
                    for at, members in enumerate(numbers):
                        one = trees.get(at) or Batch(members, first, terms, weights)
                        if len(numbers) == 1:
                            trees[at] = one
                        local = np.minimum(np.searchsorted(one.terms, term), len(one.terms) - 1)
                        mine = one.terms[local] == term
                        if mine.any():
                            tree = ShardTree(doc[mine], local[mine], value[mine], value[mine] * weight[term[mine]])
                            walk(one, tree, lambda: best.floor, lambda q, d, s: best.add(q, keys.take(pa.array(d)), s))
            if best:
                best.settle()
                yield from best.rows.append_column("name", pa.chunked_array([names.take(best.rows["item"].combine_chunks())])).to_batches()

        return run

    columns = shards.select("shard", "keys", "n_terms", "doc", "term", "often")
    is_opening = F.pmod(F.xxhash64("shard"), F.lit(opening)) == 0
    floor = np.ones(len(held), np.int64)
    opened = stage(_ranked(columns.where(is_opening).mapInArrow(searched(context.broadcast(floor)), schema), k), "lexical-opening")
    reached = opened.where(F.col("rank") == k).select("item", "score").toArrow()
    floor = floor.copy()
    floor[reached["item"].to_numpy()] = np.maximum(reached["score"].to_numpy(), 1)
    rest = columns.where(~is_opening).mapInArrow(searched(context.broadcast(floor)), schema)
    ranked = _ranked(opened.drop("rank").unionByName(rest), k)
    return ranked.select(F.col("name").alias("item"), "rank", "key", "score")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every item; tasks drop the others before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
