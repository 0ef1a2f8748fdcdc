import numpy as np

from stormlake.llm.ann import build_lists, search_lists

SCHEMA = "vec_id long, embedding array<float>"


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16)]
    index = build_lists(spark.createDataFrame(rows, SCHEMA))
    found = search_lists(index, index.vectors.where("key % 100 = 0")).collect()
    exact = vectors.astype(np.float64)
    hits = total = 0
    for query in range(0, 3000, 100):
        scores = exact @ exact[query]
        scores[query] = -np.inf
        best = set(np.argsort(-scores, kind="stable")[:20].tolist())
        mine = sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - scores[r["key"]]) < 1e-9 for r in mine)
        hits += len(best & {r["key"] for r in mine})
        total += 20
    assert hits >= 0.9 * total


def test_nothing_usable(spark):
    assert build_lists(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], SCHEMA)) is None


def exact_rows(vectors, queries, k=20):
    """Ranks by definition: largest inner product first, ties to the smaller id, without the query's own id."""
    out = set()
    for query in queries:
        scores = [(-float(np.dot(v, vectors[query])), key) for key, v in vectors.items() if key != query]
        out |= {(query, rank, key) for rank, (_, key) in enumerate(sorted(scores)[:k], 1)}
    return out


def found_rows(spark, rows, queries, **options):
    index = build_lists(spark.createDataFrame(rows, SCHEMA), **options)
    found = search_lists(index, index.vectors.where(index.vectors["key"].isin(queries)), ratio=10.0).collect()
    return {(r["query_id"], r["rank"], r["key"]) for r in found}


def test_reading_all_lists_is_exact_with_ties_repeats_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    # small whole numbers: products are exact and often equal
    made = {i: rng.integers(-2, 3, 6).astype(float) + 0.5 for i in range(400)}
    hot = made[7]
    made |= {i: hot for i in range(400, 600)}
    rows = [(i, v.tolist()) for i, v in made.items()]
    rows += [(3, made[3].tolist()), (None, made[5].tolist()), (800, [1.0] * 5)]
    queries = [0, 3, 7, 20, 420, 599]
    for size in (16, 100, 1000):
        assert found_rows(spark, rows, queries, list_size=size) == exact_rows(made, queries)


def test_fewer_candidates_than_asked_for(spark):
    made = {i: np.array([float(i), 1.0]) for i in range(1, 6)}
    rows = [(i, v.tolist()) for i, v in made.items()]
    assert found_rows(spark, rows, [1, 5]) == exact_rows(made, [1, 5])
    assert found_rows(spark, rows[:1], [1]) == set()


def test_recall_of_the_registered_query(spark):
    from stormlake.llm.queries import llm_queries

    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    vectors = {int(k): np.array(v, float) for k, v in zip(table["vec_id"], table["embedding"]) if v is not None}
    keys = np.array(sorted(vectors))
    matrix = np.array([vectors[k] for k in keys])
    found = {}
    for r in llm_queries()["op1_ann"](spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for query in keys[keys % 20 == 0]:
        scores = matrix @ vectors[query]
        scores[keys == query] = -np.inf
        best = set(keys[np.lexsort((keys, -scores))[:20]].tolist())
        hits, total = hits + len(best & found[query]), total + 20
    print("recall", hits / total)
    assert hits >= 0.9 * total
