"""Products of matrices held as rows of arrays or as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_transposed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of A times B transposed, summed in double: an equi-join on the coordinate and a partial sum.

    ``a`` has (row, vec), ``b`` has (col, vec); rows of another length are an error.
    """
    width = b.agg(F.max(F.size("vec")).alias("n"), F.min(F.size("vec")).alias("m"))
    left = a.crossJoin(F.broadcast(width))
    fits = F.when((F.size("vec") == F.col("n")) & (F.col("n") == F.col("m")), F.col("vec")).otherwise(F.raise_error(F.lit("inner dimensions differ")).cast("array<float>"))
    left = left.withColumn("vec", fits).select("row", F.posexplode("vec").alias("j", "x"))
    right = b.select("col", F.posexplode("vec").alias("j", "y"))
    cells = left.join(right, "j").groupBy("row", "col").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("value"))
    return cells


def product_transposed_fp32(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A times B transposed with every step rounded to single precision, in order; an error where a value overflows."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("inner dimensions differ")
    x, y = narrowed(a), narrowed(b)
    out = np.zeros((len(x), len(y)), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(x.shape[1]):
            out += np.outer(x[:, k], y[:, k])
    return checked(out)


def narrowed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return checked(np.asarray(x).astype(np.float32))


def checked(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise OverflowError("a value is too large for single precision")
    return x
