"""Vector expressions and the plane signs used for bucketing."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared after rounding, so that rows with equal vectors tie and are
# ordered by id whatever order their products were summed in.
SCORE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def plane_signs(planes: int, dim: int) -> np.ndarray:
    """``planes`` rows of ``dim`` signs, a fixed function of their position."""
    x = np.arange(1, planes * dim + 1, dtype=np.int64)
    mixed = (x * x * 2654435761 + x * 40503) % 4294967296
    return np.where(mixed >= 2147483648, 1.0, -1.0).reshape(planes, dim)
