"""Top-k similarity by inner product."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SCORE_DECIMALS, dot, plane_signs
from ..session import stage
from ..sources.tables import layout
from .blocks import BLOCK_ROWS, exact_top_k, fits, plane_sides, vector_blocks
from .embed import DIMENSIONS, embed

SEARCH_K = 4
RETRIEVER_K = 3
#: vectors that a bucket of the hash index holds on average, and buckets that a query opens
BUCKET_ROWS, PROBES = 64, 16
MOST_PLANES = 24
#: the first planes name the folder of a bucket
SHELF_PLANES = 6


def nearest(docs: DataFrame, vector: list[float], k: int, key: str, embedding: str) -> DataFrame:
    """The k best documents for one vector, with their score: a scan and a bounded sort."""
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    score = F.round(dot(F.col(embedding), wanted), SCORE_DECIMALS)
    usable = docs.where(F.size(embedding) == len(vector))
    return usable.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def _rank(scored: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, docs: DataFrame, k: int, query_key: str, key: str, dim: int, embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_key, key, score, rank``: the exact k best documents of every query.

    Vectors of another length than ``dim``, with a hole, or all zero take no part. A job that searches the
    same documents again keeps their ``vector_blocks`` and calls ``top_k_of_blocks``.
    """
    blocks = vector_blocks(docs, key, embedding, dim, block_rows)
    return top_k_of_blocks(queries, blocks, k, query_key, key, dim, embedding)


def top_k_of_blocks(
    queries: DataFrame, blocks: DataFrame, k: int, query_key: str, key: str, dim: int, embedding: str = "embedding"
) -> DataFrame:
    found = exact_top_k(queries, blocks, k, query_key, embedding, dim)
    return _rank(found.select(F.col("asked").alias(query_key), F.col("key").alias(key), "score"), query_key, key, k)


def search(
    queries: DataFrame, docs: DataFrame, columns: list[str], query_key: str, key: str, dim: int, k: int = SEARCH_K,
) -> DataFrame:
    """Top-k with chosen document columns; the few found keys look their rows up."""
    found = top_k(queries, docs, k, query_key, key, dim)
    wanted = docs.select(*dict.fromkeys([key, *columns]))
    return found.join(wanted, key).select(query_key, "rank", "score", *columns)


def search_text(
    texts: DataFrame, docs: DataFrame, columns: list[str], text_key: str, text: str, key: str,
    k: int = SEARCH_K, dim: int = DIMENSIONS,
) -> DataFrame:
    """The same for plain texts: each is embedded as the index was. Equal texts are searched once."""
    asked = texts.select(F.col(text_key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    asked = asked.withColumn("_text_id", F.sha2("_text", 256))
    vectors = embed(asked.select("_text_id", "_text").dropDuplicates(["_text_id"]), "_text_id", "_text", dim)
    found = search(vectors, docs, columns, "_text_id", key, dim, k)
    return asked.select(text_key, "_text_id").join(found, "_text_id").drop("_text_id")


def plane_count(n_vectors: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Planes that leave about ``bucket_rows`` vectors in a bucket, so buckets do not grow with the corpus."""
    return max(1, min(MOST_PLANES, math.ceil(math.log2(max(1, n_vectors) / bucket_rows))))


def _probes(embedding: Column, dim: int, planes: int, n: int) -> Column:
    """The vector's bucket and its neighbours, nearest first: ``n`` at most.

    A neighbour lies beyond some of the planes; its distance is the sum of the squared margins of the
    vector to those planes. Sets of planes are taken in the order of that sum, by a heap of
    sets of the nearest planes that grow and shift by one.
    """
    signs = plane_signs(planes, dim)
    weights = 2 ** np.arange(planes)[::-1]

    @F.pandas_udf("array<int>")
    def nearest_buckets(vectors):
        import heapq

        import pandas as pd

        margins = np.array(vectors.tolist(), dtype=np.float64).reshape(-1, dim) @ signs.T
        own = (margins >= 0) @ weights
        # crossing a plane adds or takes its weight
        steps = np.where(margins >= 0, -weights, weights)
        order = np.argsort(margins**2, axis=1, kind="stable")
        out = []
        for row, bucket in enumerate(own.tolist()):
            cost, step = (margins[row] ** 2)[order[row]], steps[row][order[row]]
            found, heap = [bucket], [(cost[0], (0,))]
            while heap and len(found) < n:
                total, crossed = heapq.heappop(heap)
                found.append(int(bucket + sum(step[i] for i in crossed)))
                last = crossed[-1]
                if last + 1 < planes:
                    heapq.heappush(heap, (total + cost[last + 1], (*crossed, last + 1)))
                    heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*crossed[:-1], last + 1)))
            out.append(found)
        return pd.Series(out)

    return nearest_buckets(embedding)


def hash_index(docs: DataFrame, key: str, embedding: str, dim: int, planes: int) -> DataFrame:
    """``shelf, bucket`` and the vector, once each: the layout to store for approximate search.

    To be written with ``partitionBy("shelf")``, sorted by bucket: a search then reads the shelves of its
    buckets and skips the row groups of others.
    """
    usable = docs.where(fits(embedding, dim)).select(F.col(key), F.col(embedding))
    bucketed = usable.withColumn("bucket", plane_sides(F.col(embedding), dim, planes))
    return bucketed.withColumn("shelf", F.shiftright("bucket", max(0, planes - SHELF_PLANES)))


def write_hash_index(index: DataFrame, path: str) -> None:
    layout(index, ("shelf",), ("bucket",)).write.partitionBy("shelf").parquet(path)


def approximate_top_k(
    queries: DataFrame, index: DataFrame, k: int, query_key: str, key: str, dim: int, planes: int,
    embedding: str = "embedding", probes: int = PROBES,
) -> DataFrame:
    """``query_key, key, score, rank`` among the documents in the buckets probed for the query.

    Found scores are exact; a near document in a bucket that is not probed is missed. More probes find more.
    """
    asked = queries.where(fits(embedding, dim)).select(
        F.col(query_key), F.col(embedding).alias("_wanted"), _probes(F.col(embedding), dim, planes, probes).alias("_buckets")
    )
    # written out so that the planner knows their size: few probes are broadcast and
    # prune the index's shelves, the index itself is not shuffled
    opened = asked.select(query_key, "_wanted", F.explode("_buckets").alias("bucket"))
    opened = stage(opened.withColumn("shelf", F.shiftright("bucket", max(0, planes - SHELF_PLANES))), "probes")
    met = index.join(opened, ["shelf", "bucket"])
    score = F.round(dot(F.col(embedding), F.col("_wanted")), SCORE_DECIMALS)
    return _rank(met.select(query_key, key, score.alias("score")), query_key, key, k)
