"""Connected components of a table of links, by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlake.session import stage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches (roots have no row).

    Large stars and small stars take turns (Kiveris et al. 2014): every node hands its larger, then its smaller
    neighbours to the smallest one. Each round is a grouped minimum and a join on the same
    key, which adaptive execution splits where a node has very many links; the number of
    rounds grows with the logarithm of the longest path. Rounds are written to the shared folder.
    Links of a node with itself, repeated ones and those with a null end do nothing.
    """
    pairs = (
        links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("node") != F.col("root")))
        .select("node", "root")
        .distinct()
    )
    pairs = stage(pairs, "component-links")
    while _unsettled(pairs).count():
        pairs = stage(_small_star(_large_star(pairs)), "component-round")
    return pairs


def extended_components(roots: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` as of ``connected_components``, after more links; only components that these join go through rounds."""
    ends = [roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")) for end in (a, b)]
    between = links.join(ends[0], a, "left").join(ends[1], b, "left")
    between = between.select(F.coalesce(f"root_{a}", a).alias("one"), F.coalesce(f"root_{b}", b).alias("other"))
    moved = connected_components(between, "one", "other")
    least = moved.select(F.col("node").alias("root"), F.col("root").alias("least"))
    kept = roots.join(least, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return stage(kept.unionByName(moved), "component-roots")


def _unsettled(pairs: DataFrame) -> DataFrame:
    """The nodes that have several roots, or one and are themselves a root; without any, ``pairs`` are the components."""
    uses = pairs.select("node", F.lit(1).alias("roots"), F.lit(0).alias("is_root")).unionByName(
        pairs.select(F.col("root").alias("node"), F.lit(0).alias("roots"), F.lit(1).alias("is_root"))
    )
    return uses.groupBy("node").agg(F.sum("roots").alias("roots"), F.max("is_root").alias("is_root")).where(F.col("roots") + F.col("is_root") > 1)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"))
    return (
        # a row for each of the pairs; small stars drop repeated ones
        both.join(least, "node").where(F.col("root") > F.col("node"))
        .select(F.col("root").alias("node"), F.col("least").alias("root"))
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("node").agg(F.min("root").alias("least"))
    moved = pairs.join(least, "node").where(F.col("root") != F.col("least")).select(F.col("root").alias("node"), F.col("least").alias("root"))
    return moved.unionByName(least.select("node", F.col("least").alias("root"))).distinct()
