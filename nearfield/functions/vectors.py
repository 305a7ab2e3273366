"""Column expressions over vectors (arrays of float or double). Sums run left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _differences(a: Column, b: Column, of: Callable[[Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: of(x.cast("double") - y.cast("double")))


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector sizes differ")).cast("double"))


def l1_distance(a: Column, b: Column) -> Column:
    return _same_size(a, b, _fold(_differences(a, b, F.abs)))


def l2_distance_sq(a: Column, b: Column) -> Column:
    return _same_size(a, b, _fold(_differences(a, b, lambda d: d * d)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_distance_sq(a, b))


def weighted_l1_distance(a: Column, b: Column, weights: Column) -> Column:
    return _fold(F.zip_with(_differences(a, b, F.abs), weights, lambda d, w: d * w))


def median_abs_difference(a: Column, b: Column) -> Column:
    """Median of absolute differences; of an even number the lower middle plus half the gap."""
    n = F.size(a)

    def middle(ranked: Column) -> Column:
        high, low = F.get(ranked, F.floor(n / 2).cast("int")), F.get(ranked, (F.floor(n / 2) - 1).cast("int"))
        return F.when(n % 2 == 1, high).otherwise(low + (high - low) * 0.5)

    # the lambda's argument is sorted once, however often it is used
    return F.get(F.transform(F.array(F.array_sort(_differences(a, b, F.abs))), middle), 0)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def gather(vec: Column, places: Column) -> Column:
    """The elements of ``vec`` at the zero-based ``places``, in their order."""
    return F.transform(places, lambda j: F.get(vec, j))


def all_finite(vec: Column) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def checked_finite(vec: Column, what: str) -> Column:
    """``vec`` itself; an error if it has a null, a NaN or an infinity."""
    return F.when(all_finite(vec), vec).otherwise(F.raise_error(F.lit(f"{what} has values that are not finite")).cast("array<double>"))


def narrowed(value: Column) -> Column:
    """Double to float; an error where the value is too large for one."""
    small = value.cast("float")
    return F.when(F.abs(small) != float("inf"), small).otherwise(F.raise_error(F.lit("value is too large for a float")).cast("float"))


def distance(metric: str) -> Callable[[Column, Column], Column]:
    """What a metric ranks by: L1, or L2 without its root."""
    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    return l1_distance if metric == "l1" else l2_distance_sq


def reported(metric: str) -> Callable[[Column, Column], Column]:
    """What a metric reports: L1, or L2 with its root."""
    distance(metric)
    return l1_distance if metric == "l1" else l2_distance


def hashed_uniform(stream: str, seed: int, *places: Column) -> Column:
    """A uniform number in [0, 1) that depends on its arguments alone, with 52 bits of their MD5."""
    text = F.concat_ws("|", F.lit(stream), F.lit(seed), *[p.cast("string") for p in places])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def register(spark: SparkSession) -> None:
    """SQL functions l1_distance, l2_distance_sq, l2_distance, vector_dot and median_abs_difference."""
    d = "zip_with(a, b, (x, y) -> cast(x as double) - cast(y as double))"
    kind = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    bodies = {
        "l1_distance": f"aggregate({d}, 0D, (s, x) -> s + abs(x))",
        "l2_distance_sq": f"aggregate({d}, 0D, (s, x) -> s + x * x)",
        "l2_distance": f"sqrt(aggregate({d}, 0D, (s, x) -> s + x * x))",
        "vector_dot": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    }
    bodies["median_abs_difference"] = (
        "element_at(array_sort(transform({d}, x -> abs(x))), cast(floor((size(a) + 1) / 2) as int)) * 0.5"
        " + element_at(array_sort(transform({d}, x -> abs(x))), cast(floor(size(a) / 2) + 1 as int)) * 0.5"
    ).replace("{d}", d)
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({kind}) RETURNS DOUBLE RETURN {body}")
