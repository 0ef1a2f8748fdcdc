"""Text embeddings: hashed bag of words, scaled to unit length."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

DIMENSIONS = 64


def embed(texts: DataFrame, key: str, text: str, dim: int = DIMENSIONS) -> DataFrame:
    """``key, embedding``: one unit vector per key; a text without words gets zeros.

    ``key`` identifies a row. Tokens are counted per text and component before the
    shuffle, so a text of any length sends at most ``dim`` rows.
    """
    words = texts.select(F.col(key), F.explode_outer(tokens(F.col(text))).alias("token"))
    component = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % dim
    counts = words.groupBy(key, component.cast("int").alias("dim")).agg(F.count("token").alias("n"))
    entry = F.struct("dim", "n")
    # at most dim entries per key
    gathered = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("dim").isNotNull(), entry))).alias("counts"),
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"),
    )

    def component_value(d: Column) -> Column:
        count = F.coalesce(F.try_element_at("counts", d), F.lit(0))
        return F.when(F.col("length") > 0, count / F.col("length")).otherwise(F.lit(0.0))

    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component_value)
    return gathered.select(key, vector.cast("array<float>").alias("embedding"))
