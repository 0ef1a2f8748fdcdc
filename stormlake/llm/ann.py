"""Approximate nearest neighbours by balanced posting lists (after SPANN, 2021).

Vectors are clustered into posting lists of about ``LIST_SIZE``. A vector near the border of several lists
is stored in each of them, up to ``COPIES``, but not in two whose centroids are next to each other. The
centroids are held in memory with a neighbour graph; a best-first walk on it finds the lists of a
vector or query. A query reads every list whose centroid is at most ``1 + RATIO`` times as far as the nearest, so queries in
dense regions read few lists and others more.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |x|^2), with M the
longest norm. Centroids are fitted on a bounded sample; every vector is indexed. Only centroids and list sizes
(``MOST_LISTS`` rows at most) are on the driver or broadcast. Lists and their queries meet in cells of about ``CELL`` vectors
and queries: a list that holds a third of all vectors, or that a third of all queries read, is
split into as many cells as it needs. A query meets its nearest lists first; from the others only vectors that score
no less than the kth found there leave their cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.session import stage

LIST_SIZE = 512
#: bounds of the fit: sampled vectors (and their bytes) and centroids
SAMPLE, SAMPLE_BYTES = 40_000, 64 << 20
MOST_LISTS = 10_000
COPIES = 4
#: a vector is stored in lists up to so many times as far as its nearest, a query reads more
BORDER, RATIO = 0.02, 0.2
#: least distance between the centroids of two lists of a vector, as a share of its own distance
SPREAD = 0.25
CELL = 1024
_NEIGHBOURS = 16
_REFINE = 4
_BATCH = 256


class Centroids:
    """Centroids in the order of the splitting tree, and for each the numbers of its graph neighbours."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, longest: float):
        self.points, self.edges, self.longest = points, edges, longest

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def walk(self, points: np.ndarray, ratio: float, sizes: np.ndarray | None = None, need: int = 0) -> np.ndarray:
        """Distances to the lists that a best-first walk reached, inf elsewhere: all reachable ones
        within ``1 + ratio`` times the nearest, and more until lists with ``need`` vectors are reached."""
        n, k = len(points), len(self.points)
        found = np.full((n, k), np.inf)
        opened = np.zeros((n, k), dtype=bool)
        starts = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        found[:, starts] = _distances(points, self.points[starts])
        live = np.arange(n)
        while len(live):
            near = found[live]
            waiting = np.where(opened[live], np.inf, near)
            best = waiting.argmin(axis=1)
            distance = waiting[np.arange(len(live)), best]
            go = distance <= (1 + ratio) * near.min(axis=1) + 1e-12
            if sizes is not None:
                go |= ((near < np.inf) @ sizes < need) & (distance < np.inf)
            live, best = live[go], best[go]
            if not len(live):
                break
            opened[live, best] = True
            fresh = self.edges[best]
            gap = self.points[fresh] - points[live][:, None, :]
            found[live[:, None], fresh] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def fit_centroids(sample: np.ndarray, longest: float, lists: int, seed: int = 5) -> Centroids:
    """Halve the sample along its widest spread until parts are small enough, then refine the means."""
    lifted = Centroids(sample, np.zeros((0, 0), int), longest).lifted(sample)
    rng = np.random.default_rng(seed)
    parts, most = [], max(1, len(sample) // max(1, lists))
    stack = [np.arange(len(sample))]
    while stack:
        part = stack.pop()
        if len(part) <= most:
            parts.append(part)
            continue
        points = lifted[part] - lifted[part].mean(axis=0)
        axis = rng.normal(size=points.shape[1])
        for _ in range(6):
            axis = points.T @ (points @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = np.argsort(points @ axis, kind="stable")
        stack += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
    centres = np.array([lifted[p].mean(axis=0) for p in parts])
    for _ in range(_REFINE):
        own = np.concatenate([_distances(lifted[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(lifted), 4096)])
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, lifted)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    _, first = np.unique(centres.round(12), axis=0, return_index=True)
    centres = centres[np.sort(first)]
    k = len(centres)
    wide = min(_NEIGHBOURS, k)
    edges = np.empty((k, wide + 2), dtype=np.int64)
    for begin in range(0, k, 1024):
        near = _distances(centres[begin : begin + 1024], centres)
        edges[begin : begin + 1024, :wide] = np.argpartition(near, wide - 1, axis=1)[:, :wide]
    # neighbours in the tree order keep the graph in one piece
    edges[:, wide], edges[:, wide + 1] = (np.arange(k) + 1) % k, (np.arange(k) - 1) % k
    return Centroids(centres, edges, longest)


def usable(vectors: DataFrame, key: str, embedding: str, dim: int | None = None) -> DataFrame:
    """``key, vector``: rows with a key and ``dim`` finite components that are not all zero.

    Without ``dim`` it is the most frequent length (of equally frequent ones the least). Of rows that repeat a key the least vector counts.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.where(
        F.col("key").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    if dim is None:
        lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = lengths["dim"] if lengths else 0
    return rows.where(F.size("vector") == dim).groupBy("key").agg(F.min("vector").alias("vector"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class PostingLists:
    """The written index: ``lists`` has ``list, key, vector``; sizes are counts of all lists."""

    def __init__(self, vectors: DataFrame, lists: DataFrame, centroids: Centroids, sizes: np.ndarray):
        self.vectors, self.lists, self.centroids, self.sizes = vectors, lists, centroids, sizes


def build_lists(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", list_size: int = LIST_SIZE, dim: int | None = None
) -> PostingLists | None:
    """Index every usable vector; None if there is none."""
    kept = stage(usable(vectors, key, embedding, dim), "ann-vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total = kept.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.max(F.size("vector")).alias("dim")).first()
    if not total["n"]:
        return None
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * total["dim"])))
    sampled = kept.orderBy(F.xxhash64("key"), "key").limit(bound).select("vector").toArrow()
    lists = min(-(-total["n"] // list_size), MOST_LISTS, max(1, bound // 4))
    fitted = fit_centroids(_matrix(sampled.column("vector")), total["longest"], lists)
    shared = kept.sparkSession.sparkContext.broadcast((fitted.points, fitted.edges, fitted.longest))

    def assigned(batches):
        centroids = Centroids(*shared.value)
        between = _distances(centroids.points, centroids.points) if len(centroids.points) <= 2048 else None
        for batch in batches:
            if not batch.num_rows:
                continue
            points = centroids.lifted(_matrix(batch.column("vector")))
            rows, owners = [], []
            for begin in range(0, len(points), _BATCH):
                part = points[begin : begin + _BATCH]
                near = centroids.walk(part, BORDER)
                ranked = np.argsort(near, axis=1)[:, : 4 * COPIES]
                for i, order in enumerate(ranked):
                    chosen: list[int] = []
                    for at in order.tolist():
                        if near[i, at] > (1 + BORDER) * near[i, order[0]] + 1e-12 or len(chosen) == COPIES:
                            break
                        to_chosen = between[at, chosen] if between is not None else _distances(centroids.points[[at]], centroids.points[chosen])[0]
                        if not chosen or to_chosen.min() >= SPREAD * near[i, at]:
                            chosen.append(at)
                    rows.extend([begin + i] * len(chosen))
                    owners.extend(chosen)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int32()), batch.column("key").take(take), batch.column("vector").take(take)], names=["list", "key", "vector"]
            )

    kind = kept.schema["key"].dataType.simpleString()
    written = stage(kept.mapInArrow(assigned, f"list int, key {kind}, vector array<double>"), "ann-lists")
    sizes = np.zeros(len(fitted.points), dtype=np.int64)
    for row in written.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    return PostingLists(kept, written, fitted, sizes)


def search_lists(index: PostingLists, queries: DataFrame, k: int = 20, ratio: float = RATIO) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` best found for each row ``key, vector`` of ``queries``.

    The score is the inner product of the given vectors in double precision; ties go to the smaller key; a query's own
    key is not among its results. If fewer vectors are indexed, all are returned.
    """
    spark = queries.sparkSession
    fitted = index.centroids
    shared = spark.sparkContext.broadcast((fitted.points, fitted.edges, fitted.longest, index.sizes))
    need = COPIES * (k + 1)
    kind = queries.schema["key"].dataType

    def probed(batches):
        *parts, sizes = shared.value
        centroids = Centroids(*parts)
        for batch in batches:
            vectors = _matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, 1))
            for begin in range(0, len(vectors), _BATCH):
                part = vectors[begin : begin + _BATCH]
                # lengths do not change which list is nearest, but make ratios comparable
                scaled = part * (centroids.longest / np.sqrt((part**2).sum(axis=1)))[:, None]
                near = centroids.walk(np.column_stack([scaled, np.zeros(len(part))]), ratio, sizes, need)
                order = np.argsort(near, axis=1)
                ranked = np.take_along_axis(near, order, axis=1)
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                chosen = (ranked < np.inf) & ((ranked <= (1 + ratio) * ranked[:, :1] + 1e-12) | (before < need)) & (sizes[order] > 0)
                rows, at = np.nonzero(chosen)
                take = pa.array(rows + begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(order[rows, at], pa.int32()), batch.column("key").take(take), batch.column("vector").take(take),
                        pa.array((before < need)[rows, at]),
                    ],
                    names=["list", "query_id", "query", "first"],
                )

    schema = T.StructType([
        T.StructField("list", T.IntegerType()), T.StructField("query_id", kind), T.StructField("query", T.ArrayType(T.DoubleType())),
        T.StructField("first", T.BooleanType()),
    ])
    probes = stage(queries.select("key", "vector").mapInArrow(probed, schema), "ann-probes")
    held = index.lists.groupBy("list").count().select("list", F.ceil(F.col("count") / CELL).cast("int").alias("vector_cells"))

    def in_cells(some: DataFrame):
        """Vectors and queries of every list, dealt over cells of which each pair meets once."""
        asked = some.groupBy("list").count().select("list", F.ceil(F.col("count") / CELL).cast("int").alias("query_cells"))
        # a row per list, MOST_LISTS at most
        cells = F.broadcast(asked.join(F.broadcast(held), "list"))
        vectors = (
            index.lists.join(cells, "list")
            .withColumn("a", F.pmod(F.xxhash64("key"), F.col("vector_cells")).cast("int"))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("query_cells") - 1)))
            .select("list", "a", "b", "key", "vector")
        )
        wanted = (
            some.join(cells, "list")
            .withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("query_cells")).cast("int"))
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("vector_cells") - 1)))
            .drop("first", "query_cells", "vector_cells")
        )
        return vectors.groupBy("list", "a", "b").cogroup(wanted.groupBy("list", "a", "b"))

    def scored(cell, left, right):
        """The best of a cell for each of its queries: a row per query."""
        names = ["query_id", "keys", "scores"]
        if not left.num_rows or not right.num_rows:
            return pa.table({names[0]: right.column("query_id").slice(0, 0), names[1]: pa.array([], pa.list_(left.schema.field("key").type)), names[2]: pa.array([], pa.list_(pa.float64()))})
        keys = np.array(left.column("key").to_pylist(), dtype=object)
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        keys, matrix, asked = keys[order], _matrix(left.column("vector"))[order], _matrix(right.column("query"))
        names_of = right.column("query_id").to_pylist()
        rough = asked @ matrix.T
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
        out_keys, out_scores = [], []
        for i, own in enumerate(names_of):
            line = rough[i].copy()
            line[keys == own] = -np.inf
            bar = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
            at = np.flatnonzero((line >= bar - slack[i]) & (line > -np.inf))
            exact = np.einsum("ij,ij->i", matrix[at], np.broadcast_to(asked[i], (len(at), asked.shape[1])))
            best = np.lexsort((at, -exact))[:k]
            out_keys.append(list(keys[at[best]]))
            out_scores.append(exact[best])
        return pa.table({
            names[0]: right.column("query_id"), names[1]: pa.array(out_keys, pa.list_(left.schema.field("key").type)),
            names[2]: pa.array(out_scores, pa.list_(pa.float64())),
        })

    def above(cell, left, right):
        """The vectors of a cell that score no less than a query's kth so far: a row per query with any."""
        names, kind_of = ["query_id", "keys", "scores"], left.schema.field("key").type
        asked, floor = right.column("query_id").combine_chunks(), right.column("floor").to_numpy()
        if not left.num_rows or not right.num_rows:
            return pa.table({names[0]: asked.slice(0, 0), names[1]: pa.array([], pa.list_(kind_of)), names[2]: pa.array([], pa.list_(pa.float64()))})
        matrix, wanted = _matrix(left.column("vector")), _matrix(right.column("query"))
        rough = wanted @ matrix.T
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
        place = {key: at for at, key in enumerate(left.column("key").to_pylist())}
        for i, own in enumerate(asked.to_pylist()):
            if own in place:
                rough[i, place[own]] = -np.inf
        row, at = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
        exact = np.einsum("ij,ij->i", matrix[at], wanted[row])
        with_any, first = np.unique(row, return_index=True)
        offsets = pa.array(np.append(first, len(row)), pa.int32())
        keys = left.column("key").combine_chunks().take(pa.array(at))
        return pa.table({
            names[0]: asked.take(pa.array(with_any)), names[1]: pa.ListArray.from_arrays(offsets, keys),
            names[2]: pa.ListArray.from_arrays(offsets, pa.array(exact)),
        })

    key_kind = index.lists.schema["key"].dataType
    result = T.StructType([
        T.StructField("query_id", kind), T.StructField("keys", T.ArrayType(key_kind)), T.StructField("scores", T.ArrayType(T.DoubleType())),
    ])
    # least negative score first, then key; a vector found in several lists has one score
    hits = F.transform(F.arrays_zip("keys", "scores"), lambda h: F.struct((F.lit(0.0) - h["scores"]).alias("far"), h["keys"].alias("key")))
    merged = lambda column: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k)
    # the nearest lists first: what scores below the kth found there need not leave its cell
    nearest = in_cells(probes.where("first")).applyInArrow(scored, result)
    nearest = stage(nearest.select("query_id", hits.alias("hits")).groupBy("query_id").agg(merged("hits").alias("hits")), "ann-nearest")
    floor = F.when(F.size("hits") >= k, F.lit(0.0) - F.get("hits", F.lit(k - 1))["far"]).otherwise(F.lit(float("-inf")))
    others = probes.where("NOT first").join(nearest.select("query_id", floor.alias("floor")), "query_id", "left")
    others = others.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    best = in_cells(others).applyInArrow(above, result).select("query_id", hits.alias("hits"))
    parted = best.unionByName(nearest).withColumn("_part", F.pmod(F.xxhash64("hits"), F.lit(16)))
    parted = parted.groupBy("query_id", "_part").agg(merged("hits").alias("hits"))
    final = parted.groupBy("query_id").agg(merged("hits").alias("hits"))
    return final.select("query_id", F.posexplode("hits").alias("_at", "hit")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("hit.key").alias("key"), (F.lit(0.0) - F.col("hit.far")).alias("score")
    )
