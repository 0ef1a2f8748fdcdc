"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Documents hang under a tree of levels, such as domain, language and source. A token budget flows from
the root down: every node shares its budget among its children by weight. A child that
cannot use its share (all its tokens, ``max_epochs`` times) is filled up, and what it leaves goes to its siblings by weight; only what a
whole subtree cannot use reaches the siblings of its parent. A leaf then takes whole epochs of its documents and
a prefix of one more: each epoch is an order by a seeded hash, and the prefix ends with the first document that
reaches the budget.

The tree has a row per leaf, whatever the corpus. A leaf's prefix is found without sorting the leaf:
its tokens are summed in ``BUCKETS`` ranges of the hash, and only the range in which the budget
ends is ordered. Documents are never shuffled; each is decided by its leaf's last hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: leading hexadecimal digits of the hash that make a range, 4096 ranges a leaf
_DIGITS = 3
SEED = 17
MAX_EPOCHS = 2
#: what has no value on a level hangs under a node of this name
NONE = "(none)"
_WHITE = r"[^\x20\x09-\x0D]+"


def token_count(text: str) -> Column:
    """Words of a text, as runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WHITE)), F.lit(0)).cast("long")


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE))


def _place(seed: int, epoch: Column, key: str) -> Column:
    """Place of a document in an epoch: a hash, the same at every size."""
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _weight(levels: Sequence[str], weights: dict[str, float]) -> Column:
    """Weight of a node among its siblings: that of its path ``a/b``, else of ``*/b``, else 1."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))))
    path = F.concat_ws("/", *levels)
    loose = F.concat(F.lit("*/" * (len(levels) - 1)), F.col(levels[-1]))
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, loose), F.lit(1.0))


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: dict[str, float], budget: int, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``budget``, whole tokens for every leaf.

    Nodes of weight 0 or less, and all below them, get nothing and hold nothing for others.
    """
    nodes = leaves.select(*levels, "tokens", (F.col("tokens") * max_epochs).cast("double").alias("_cap"))
    for depth in range(1, len(levels) + 1):
        nodes = nodes.withColumn(f"_w{depth}", _weight(levels[:depth], weights))
    usable = F.lit(True)
    for depth in range(1, len(levels) + 1):
        usable = usable & (F.col(f"_w{depth}") > 0)
    nodes = nodes.withColumn("_cap", F.when(usable, F.col("_cap")).otherwise(0.0))
    shares = None
    for depth in range(1, len(levels) + 1):
        own, parent = list(levels[:depth]), list(levels[: depth - 1])
        level = nodes.groupBy(*own).agg(F.sum("_cap").alias("_cap"), F.first(f"_w{depth}").alias("_w")).where(F.col("_cap") > 0)
        if shares is None:
            level = level.withColumn("_have", F.lit(float(budget)))
        else:
            level = level.join(shares, parent)
        order = Window.partitionBy(*parent).orderBy(F.col("_cap") / F.col("_w"), *own)
        level = (
            level.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("_rest", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("_rate", (F.col("_have") - F.col("_full")) / F.col("_rest"))
            .withColumn("_short", F.col("_cap") / F.col("_w") <= F.col("_rate"))
        )
        rate = F.max(F.when(~F.col("_short"), F.col("_rate"))).over(Window.partitionBy(*parent))
        share = F.when(F.col("_short"), F.col("_cap")).otherwise(F.greatest(F.lit(0.0), F.col("_w") * rate))
        shares = level.select(*own, share.alias("_have"))
    return (
        leaves.join(shares, list(levels), "left")
        .withColumn("budget", F.floor(F.coalesce("_have", F.lit(0.0)) + 1e-6).cast("long"))
        .drop("_have")
    )


def plan_mix(
    rows: DataFrame, levels: Sequence[str], weights: dict[str, float], budget: int | None = None, share: float = 0.5,
    key: str = "doc_id", tokens: str = "n_tokens", max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """A row per leaf: levels, ``tokens``, ``budget``, ``epochs`` (taken whole) and ``last`` (the
    last hash taken of one more epoch, null if none).

    ``budget`` is in tokens; without it, ``share`` of all tokens of ``rows``. An empty table gives an empty plan.
    """
    rows = rows.select(*(_level(name).alias(name) for name in levels), F.col(key).alias("_key"), F.coalesce(tokens, F.lit(0)).alias("_tokens"))
    if budget is None:
        budget = int((rows.agg(F.sum("_tokens")).first()[0] or 0) * share)
    leaves = rows.groupBy(*levels).agg(F.sum("_tokens").alias("tokens"))
    plan = (
        leaf_budgets(leaves, levels, weights, budget, max_epochs)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(0).cast("int"))
        .withColumn("_left", F.col("budget") - F.col("epochs") * F.col("tokens"))
    )
    partial = plan.where((F.col("_left") > 0) & (F.col("epochs") < max_epochs)).select(*levels, "epochs", "_left")
    placed = rows.join(partial, list(levels)).withColumn("_place", _place(seed, F.col("epochs"), "_key"))
    placed = placed.withColumn("_range", F.substring("_place", 1, _DIGITS))
    before = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        placed.groupBy(*levels, "_range").agg(F.sum("_tokens").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(partial.select(*levels, "_left"), list(levels))
        .where(F.col("_before") < F.col("_left"))
        .groupBy(*levels).agg(F.max(F.struct("_range", "_before")).alias("_end"))
        .select(*levels, F.col("_end._range").alias("_range"), F.col("_end._before").alias("_before"))
    )
    inside = Window.partitionBy(*levels).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        placed.join(ends, [*levels, "_range"])
        .groupBy(*levels, "_place").agg(F.sum("_tokens").alias("_sum"), F.first("_before").alias("_before"), F.first("_left").alias("_left"))
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum("_sum").over(inside), F.lit(0)))
        .where(F.col("_before") < F.col("_left"))
        .groupBy(*levels).agg(F.max("_place").alias("last"))
    )
    return plan.drop("_left").join(cuts, list(levels), "left").select(*levels, "tokens", "budget", "epochs", "last")


def take_mix(docs: DataFrame, plan: DataFrame, levels: Sequence[str], key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """A row of ``docs`` for each epoch in which it is taken, with ``epoch`` from 0.

    Levels are compared by the names that ``plan_mix`` gives them, so a null one is a node of its own. Rows that
    repeat a key share its place and are taken together. A column named ``epoch`` is replaced.
    """
    names = {name: f"_level{i}" for i, name in enumerate(levels)}
    wanted = plan.select(*(F.col(name).alias(new) for name, new in names.items()), F.col("epochs").alias("_epochs"), F.col("last").alias("_last"))
    kept = [c for c in docs.columns if c != "epoch"]
    marked = docs.withColumns({new: _level(name) for name, new in names.items()})
    taken = F.col("_epochs") + F.when(_place(seed, F.col("_epochs"), key) <= F.col("_last"), 1).otherwise(0)
    return (
        marked.join(wanted, list(names.values()))
        .withColumn("_taken", taken)
        .where(F.col("_taken") > 0)
        .select(*kept, F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)).alias("epoch"))
    )
