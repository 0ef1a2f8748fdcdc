"""Exact top-k by inner product without scoring all pairs.

Vectors are sorted by the sides of some planes that they lie on and cut into blocks of ``BLOCK_ROWS``, so a block is
small in space. A block knows its centre, the largest distance from it and the largest norm; no
vector in it can score more with a query than the centre's score plus distance times the query's norm. A query is first
scored in the block whose centre suits it best, which gives it a kth score. Then it only meets the
blocks whose bound is not below that. What is skipped cannot be among the best, so the result is exact.

Blocks and queries travel as rows of packed vectors, joined by Spark; nothing passes the driver. A
task holds one block and one group of queries at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import SCORE_DECIMALS, plane_signs
from ..session import stage

# tasks receive this module's code with the job, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1024
#: queries of one packed row, and blocks whose bounds are taken at a time
GROUP_ROWS = 1024
#: planes whose sides vectors are sorted by
PLANES = 24
#: bounds are raised by this much, more than any rounding of a score
_SLACK = 1e-8


def fits(embedding: str, dim: int) -> Column:
    """Vectors of the given length, without a hole and not all zero, take part."""
    return (
        (F.size(embedding) == dim)
        & ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x.cast("double")))
        & F.exists(F.col(embedding), lambda x: x != 0)
    )


def plane_sides(embedding: Column, dim: int, planes: int) -> Column:
    """The sides of ``planes`` fixed planes that a vector lies on, as bits; the first plane is the highest."""
    signs = plane_signs(planes, dim)
    weights = 2 ** np.arange(planes)[::-1]

    @F.pandas_udf("int")
    def sides(vectors):
        import pandas as pd

        matrix = np.array(vectors.tolist(), dtype=np.float64).reshape(-1, dim)
        return pd.Series((matrix @ signs.T >= 0) @ weights, dtype="int32")

    return sides(embedding)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def vector_blocks(docs: DataFrame, key: str, embedding: str, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written blocks: ``block, keys, vectors, n, centre, radius, longest``.

    Vectors are sorted by the sides of the planes they lie on, and every ``block_rows`` in a row are a block. Equal sides,
    such as those of copies, are spread over tasks by the key.
    """
    usable = docs.where(fits(embedding, dim)).select(F.col(key).alias("key"), F.col(embedding).alias("v"))
    coded = usable.select("key", "v", plane_sides(F.col("v"), dim, PLANES).alias("code"), F.xxhash64("key").alias("h"))
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("vectors", T.BinaryType()),
        T.StructField("n", T.IntegerType()), T.StructField("centre", T.BinaryType()), T.StructField("radius", T.DoubleType()),
        T.StructField("longest", T.DoubleType()),
    ])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        matrix = _matrix(rows["v"].combine_chunks(), dim)
        centre = matrix.mean(axis=0)
        radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1)).max())
        longest = float(np.sqrt((matrix**2).sum(axis=1)).max())
        keys = pa.ListArray.from_arrays(np.array([0, len(matrix)], np.int32), rows["key"].combine_chunks())
        values = [[number], keys, [matrix.tobytes()], [len(matrix)], [centre.tobytes()], [radius], [longest]]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types)], names=names)

    def packed(batches):
        number, waiting = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            one = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, one]) if waiting else one
            while waiting.num_rows >= block_rows:
                yield block(number, waiting.slice(0, block_rows))
                number, waiting = number + 1, waiting.slice(block_rows)
        if waiting and waiting.num_rows:
            yield block(number, waiting)

    return stage(coded.sort("code", "h").select("key", "v").mapInArrow(packed, schema), "vector-blocks")


def query_groups(queries: DataFrame, query_key: str, embedding: str, dim: int) -> DataFrame:
    """The written queries, ``group, asked, matrix``, at most ``GROUP_ROWS`` a row."""
    usable = queries.where(fits(embedding, dim)).select(F.col(query_key).alias("asked"), F.col(embedding).alias("v"))
    schema = T.StructType([
        T.StructField("group", T.LongType()), T.StructField("asked", T.ArrayType(queries.schema[query_key].dataType)),
        T.StructField("matrix", T.BinaryType()),
    ])
    names = schema.names

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                asked = pa.ListArray.from_arrays(np.array([0, part.num_rows], np.int32), part.column("asked"))
                yield pa.RecordBatch.from_arrays([pa.array([number]), asked, pa.array([_matrix(part.column("v"), dim).tobytes()])], names=names)
                number += 1

    return stage(usable.mapInArrow(packed, schema), "query-groups")


def block_bounds(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Centres and bounds of many blocks a row, once for each group of queries: ``group, blocks, centres, radius, longest, n``.

    Every group has to look at every bound; of the groups, the numbers alone are listed.
    """
    def packed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                numbers = [
                    part.column(name).to_numpy().astype(kind).tobytes()
                    for name, kind in (("block", np.int64), ("radius", np.float64), ("longest", np.float64), ("n", np.int64))
                ]
                centres = b"".join(part.column("centre").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*numbers, centres)], names=["blocks", "radius", "longest", "n", "centres"])

    rows = blocks.select("block", "radius", "longest", "n", "centre").mapInArrow(
        packed, "blocks binary, radius binary, longest binary, n binary, centres binary"
    )
    numbers = F.array(*[F.lit(r["group"]) for r in groups.select("group").collect()]).cast("array<bigint>")
    return rows.withColumn("group", F.explode(numbers))


def _read(batch: pa.RecordBatch, i: int, name: str, kind=np.float64) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), kind)


def first_blocks(summaries: DataFrame, groups: DataFrame, dim: int, k: int) -> DataFrame:
    """``group, place, block``: for each query the block of at least ``k`` vectors whose centre scores highest."""

    def chosen(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries = _read(batch, i, "matrix").reshape(-1, dim)
                scores = queries @ _read(batch, i, "centres").reshape(-1, dim).T
                scores[:, _read(batch, i, "n", np.int64) < k] -= 1e300
                best = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(queries), batch.column("group")[i].as_py())), pa.array(np.arange(len(queries), dtype=np.int32)),
                        pa.array(_read(batch, i, "blocks", np.int64)[best]), pa.array(scores[np.arange(len(queries)), best]),
                    ],
                    names=["group", "place", "block", "score"],
                )

    met = summaries.join(groups.select("group", "matrix"), "group")
    rows = met.mapInArrow(chosen, "group long, place int, block long, score double")
    return rows.groupBy("group", "place").agg(F.max_by("block", "score").alias("block"))


def further_blocks(summaries: DataFrame, groups: DataFrame, floors: DataFrame, dim: int) -> DataFrame:
    """``group, block, places``: the queries of a group that a block's bound does not rule out.

    ``floors`` holds ``group, place, block, floor``: the block that was scored first, and the kth score there.
    """
    by_group = floors.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "block", "floor"))).alias("floors"))

    def chosen(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries = _read(batch, i, "matrix").reshape(-1, dim)
                held = batch.column("floors")[i].values
                floor, done = (held.field(name).to_numpy(zero_copy_only=False) for name in ("floor", "block"))
                blocks = _read(batch, i, "blocks", np.int64)
                norms = np.sqrt((queries**2).sum(axis=1))[:, None]
                bound = queries @ _read(batch, i, "centres").reshape(-1, dim).T + norms * _read(batch, i, "radius")
                bound = np.minimum(bound, norms * _read(batch, i, "longest"))
                wanted = (bound * (1 + 1e-12) + _SLACK >= floor[:, None]) & (blocks != done[:, None])
                found = np.flatnonzero(wanted.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), batch.column("group")[i].as_py())), pa.array(blocks[found]),
                        pa.array([np.flatnonzero(wanted[:, b]).astype(np.int32) for b in found], pa.list_(pa.int32())),
                    ],
                    names=["group", "block", "places"],
                )

    met = summaries.join(groups.select("group", "matrix"), "group").join(by_group, "group")
    return met.mapInArrow(chosen, "group long, block long, places array<int>")


def _scored(pairs: DataFrame, blocks: DataFrame, groups: DataFrame, k: int, dim: int) -> DataFrame:
    """``group, place, block, asked, key, score``: the k best vectors of a block for each of the places."""
    key_type, asked_type = (df.schema[name].dataType.elementType for df, name in ((blocks, "keys"), (groups, "asked")))
    schema = T.StructType([
        T.StructField("group", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("asked", asked_type), T.StructField("key", key_type), T.StructField("score", T.DoubleType()),
    ])
    names, decimals = schema.names, SCORE_DECIMALS

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                places = batch.column("places")[i].values.to_numpy()
                keys, asked = batch.column("keys")[i].values, batch.column("asked")[i].values
                queries = _read(batch, i, "matrix").reshape(-1, dim)[places]
                scores = np.round(queries @ _read(batch, i, "vectors").reshape(-1, dim).T, decimals)
                # ties go by key: places of the keys in their order
                order = np.empty(len(keys), np.int64)
                order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                bar = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
                row, column = np.nonzero(scores >= bar[:, None])
                at = np.lexsort((order[column], -scores[row, column], row))
                row, column = row[at], column[at]
                heads = np.searchsorted(row, np.arange(len(places)))
                kept = np.arange(len(row)) - heads[row] < k
                row, column = row[kept], column[kept]
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("group")[i].as_py())), pa.array(places[row]), pa.array(np.full(n, batch.column("block")[i].as_py())),
                        asked.take(pa.array(places[row])), keys.take(pa.array(column)), pa.array(scores[row, column]),
                    ],
                    names=names,
                )

    met = pairs.join(blocks.select("block", "keys", "vectors"), "block").join(groups, "group")
    return met.mapInArrow(best, schema)


def exact_top_k(queries: DataFrame, blocks: DataFrame, k: int, query_key: str, embedding: str, dim: int) -> DataFrame:
    """``asked, key, score``: candidates that hold the exact k best of every query, at most k from each block."""
    groups = query_groups(queries, query_key, embedding, dim)
    summaries = block_bounds(blocks, groups)
    firsts = first_blocks(summaries, groups, dim, k).groupBy("group", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    first = stage(_scored(firsts, blocks, groups, k, dim), "first-scores")
    floors = first.groupBy("group", "place", "block").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor")
    )
    further = _scored(further_blocks(summaries, groups, floors, dim), blocks, groups, k, dim)
    return first.unionByName(further).select("asked", "key", "score")
