"""Dataset preparation: splits, normalisation, centroids, clustering, transposition, generation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from nearfield.functions.shipping import ship


_DIGITS = 3  # of a hash that say which of 4,096 parts of a label a row is in


def _place(seed: int, key: Column) -> Column:
    """A hash that shuffles rows the same way for a seed, wherever they are."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def stratified_split(df: DataFrame, fraction: float, seed: int, key: str = "vec_id", label: str = "label", group: str | None = None) -> DataFrame:
    """``df`` with role ``pool`` or ``query``: of each label, round-half-even(n * fraction) groups, at least one and at
    most all but one, go to the pool. Groups (default: rows) never straddle; one in two labels is an error."""
    unit = group or key
    units = df.select(F.col(label).alias("_label"), F.col(unit).alias("_unit")).distinct()
    labels = units.groupBy("_unit").agg(F.count("*").alias("_labels"))
    units = units.withColumn("_place", _place(seed, F.col("_unit"))).withColumn("_part", F.substring("_place", 1, _DIGITS))
    # a label is counted by the first digits of the hashes: units of only one such part have to be put in order
    parts = units.groupBy("_label", "_part").agg(F.count("*").alias("_c"))
    by = Window.partitionBy("_label")
    before = F.coalesce(F.sum("_c").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_c").over(by)
    parts = parts.select(F.col("_label").alias("_of"), F.col("_part").alias("_at"), "_c", before.alias("_before"), F.greatest(F.lit(1), F.least(n - 1, F.bround(n * fraction).cast("bigint"))).alias("_pool"))
    units = units.join(parts, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    split = (F.col("_before") < F.col("_pool")) & (F.col("_before") + F.col("_c") > F.col("_pool"))
    rank = F.row_number().over(Window.partitionBy("_label", "_part").orderBy("_place", "_unit")) + F.col("_before")
    sure = units.where(~split).select("_unit", (F.col("_before") < F.col("_pool")).alias("_in"))
    close = units.where(split).withColumn("_rank", rank).select("_unit", (F.col("_rank") <= F.col("_pool")).alias("_in"))
    roles = sure.unionByName(close).join(labels, "_unit")
    role = F.when(F.col("_labels") > 1, F.raise_error(F.lit("a group has two labels")).cast("string")).when(F.col("_in"), "pool").otherwise("query")
    roles = roles.select("_unit", role.alias("role"))
    return df.join(roles, df[unit] == roles["_unit"]).select(*[df[c] for c in df.columns], "role")


def role_index(df: DataFrame, role: str = "role", order: str = "sample_index", parts: int = 256) -> DataFrame:
    """``df`` with role_row_index: each row's zero-based place within its role.

    Rows are numbered within ranges of a numeric ``order`` and the ranges' counts are added up, so that a role with
    most of the rows is shared by ``parts`` tasks; where the ranges lie doesn't change the result.
    """
    if not isinstance(df.schema[order].dataType, NumericType):
        return df.withColumn("role_row_index", F.row_number().over(Window.partitionBy(role).orderBy(order)) - 1)
    bounds = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    place = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b < F.col(order))) if bounds else F.lit(0)
    rows = df.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(place))
    counts = rows.groupBy(F.col(role).alias("_role"), F.col("_part").alias("_range")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_role").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_role", "_range", before.alias("_before"))  # at most ``parts`` rows a role
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy(role, "_part").orderBy(order)) - 1)
    rows = rows.join(counts, F.col(role).eqNullSafe(F.col("_role")) & (F.col("_part") == F.col("_range")))
    return rows.select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias("role_row_index"))


def cyclic_holdout(angle: Column, start: int, count: int, step: int, cycle: int = 360) -> Column:
    """Whether an angle is one of ``count`` that follow ``start`` in steps, around the cycle."""
    return F.pmod(angle - start, F.lit(cycle)) < count * step


def _cells(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, F.posexplode("vec").alias("j", "v"))


def _vectors(cells: DataFrame, by: list[str], value: Column) -> DataFrame:
    return cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", value.alias("v")))).alias("c")).select(*by, F.col("c.v").alias("vec"))


def class_centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, vec): the mean of each class, averaged in double and stored in single precision."""
    means = _cells(df, label).groupBy(label, "j").agg(F.avg(F.col("v").cast("double")).cast("float").alias("v"))
    return _vectors(means, [label], F.col("v"))


def top_variance(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(label, rank, j, variance): the k coordinates of the largest population variance in each class, lower j first on ties."""
    found = _cells(df, label).groupBy(label, "j").agg(F.var_pop(F.col("v").cast("double")).alias("variance"))
    order = Window.partitionBy(label).orderBy(F.desc(F.round("variance", 12)), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(label, "rank", "j", "variance")


def fit_normaliser(pool: DataFrame) -> DataFrame:
    """(j, mean, scale) over the pool: population deviation, 1 where it is zero; both in single precision."""
    stats = _cells(pool).groupBy("j").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    return stats.select("j", F.col("m").cast("float").alias("mean"), F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).cast("float").alias("scale"))


def normalise(df: DataFrame, normaliser: DataFrame) -> DataFrame:
    """``df`` with vec replaced by (vec - mean) / scale."""
    row = normaliser.agg(F.array_sort(F.collect_list(F.struct("j", "mean", "scale"))).alias("n")).select(F.col("n.mean").alias("_m"), F.col("n.scale").alias("_s"))
    scaled = F.zip_with(F.zip_with("vec", "_m", lambda v, m: v - m), "_s", lambda v, s: v / s)
    wide = df.crossJoin(F.broadcast(row))
    return wide.select(*[scaled.alias(c) if c == "vec" else c for c in df.columns])


def log2_plus_one(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.log2(x.cast("double") + 1))


def channel_share(vec: Column, maximum: int) -> Column:
    """Channel values over their maximum, in [0, 1]."""
    return F.transform(vec, lambda x: (x / F.lit(maximum)).cast("float"))


def transpose(features: DataFrame, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """(sample, vec) from long feature-major cells: vec in order of the feature."""
    rows = features.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("j"), F.col(value).alias("v")))).alias("c"))
    return rows.select(sample, F.col("c.v").cast("array<float>").alias("vec"))


def nearest_rivals(refs: DataFrame) -> DataFrame:
    """(ref_id, rival_id, dist_sq): each reference's nearest other one."""
    from nearfield.operators import scan

    def work(ids: np.ndarray, held: np.ndarray) -> scan.Work:
        of = scan.summed(held, "l2")

        def run(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            own, at = batch.column(0).to_numpy(), 0
            for d in of(scan.prepared(batch, None)):
                d[own[at : at + len(d)][:, None] == ids] = np.inf
                best = d.argmin(axis=1)
                yield [batch.column(0).slice(at, len(d)), pa.array(ids[best]), pa.array(d[np.arange(len(d)), best])]
                at += len(d)

        return run

    parts = scan.by_block(refs.withColumnRenamed("ref_id", "query_id"), refs, scan.blocks_for(scan.measured(refs)), work, "query_id bigint, rival_id bigint, d double")
    best = reduce(DataFrame.unionAll, parts).where(F.col("d") < float("inf")).groupBy(F.col("query_id").alias("ref_id")).agg(F.min(F.struct("d", "rival_id")).alias("x"))
    return best.select("ref_id", "x.rival_id", F.col("x.d").alias("dist_sq"))


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(center_id, size, vec): the means of the points nearest to each center; a center without points is left out."""
    from nearfield.operators.scan import nearest

    found = nearest(points.withColumnRenamed("vec_id", "query_id"), centers.withColumnRenamed("center_id", "ref_id"), "l2")
    cells = _cells(points.join(found.select(F.col("query_id").alias("vec_id"), F.col("ref_id").alias("center_id")), "vec_id"), "center_id")
    means = cells.groupBy("center_id", "j").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    return means.groupBy("center_id").agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).select("center_id", "size", F.col("c.v").alias("vec"))


def kmeans(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """Assignments by k-means++ and Lloyd steps; an empty cluster takes the farthest point of one that can spare it."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < k:
        d = ((x[:, None] - x[chosen]) ** 2).sum(axis=2).min(axis=1)
        free = np.setdiff1d(np.arange(len(x)), chosen)
        pick = int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(free[0])
        chosen.append(pick if pick not in chosen else int(free[d[free].argmax()]))
    centers, own = x[chosen].copy(), None
    for _ in range(iterations):
        d = np.maximum(0, (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * x @ centers.T)
        now = d.argmin(axis=1)
        for empty in np.setdiff1d(np.arange(k), now):
            spare = np.isin(now, np.flatnonzero(np.bincount(now, minlength=k) > 1))
            far = np.where(spare, d[np.arange(len(x)), now], -1).argmax()
            now[far] = empty
        if own is not None and (now == own).all():
            break
        own = now
        centers = np.stack([x[own == c].mean(axis=0) for c in range(k)])
    return own


def sub_centroids(pool: DataFrame, per_class: int, features: int = 256, iterations: int = 50, seed: int = 42) -> DataFrame:
    """(label, cluster, size, vec): each class split by k-means on its most variable coordinates, means over all of them.

    A class is one group of a task; it must have ``per_class`` rows at least.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        if len(x) < per_class:
            raise ValueError("a class has fewer rows than centroids are wanted")
        label = int(pdf["label"].iloc[0])
        kept = np.argsort(-x.var(axis=0), kind="stable")[:features]
        own = kmeans(x[:, np.sort(kept)], per_class, iterations, seed + label * 1_000_003)
        order = sorted(range(per_class), key=lambda c: int(np.flatnonzero(own == c)[0]))
        rows = [(label, n, int((own == c).sum()), x[own == c].mean(axis=0).astype(np.float32)) for n, c in enumerate(order)]
        return pd.DataFrame(rows, columns=["label", "cluster", "size", "vec"])

    ship(pool.sparkSession)
    return pool.select("vec_id", "label", "vec").groupBy("label").applyInPandas(split, "label int, cluster int, size int, vec array<float>")


def synthetic(spark: SparkSession, references: int = 64, queries: int = 512, dimensions: int = 16_384, informative: int = 2_048, background_scale: float = 0.02, query_noise: float = 0.02, interpolations: tuple[float, ...] = (0.30, 0.45, 0.49, 0.497), seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(refs, queries) whose exact nearest reference is the query's label: each query lies between its target and
    the target's nearest rival, nearer to the target. The matrices are made on the driver, whose memory bounds them."""
    if not all(0 <= t < 0.5 for t in interpolations):
        raise ValueError("an interpolation must lie in [0, 0.5)")
    rng = np.random.default_rng(seed)
    x = rng.normal(0, background_scale, (references, dimensions))
    own = np.sort(rng.choice(dimensions, informative, replace=False))
    x[:, own] += rng.normal(0, 1, (references, informative)) * rng.gamma(1.0, 1.0, informative)
    x = x.astype(np.float32)
    wide = x.astype(np.float64)
    d = (wide * wide).sum(axis=1)[:, None] + (wide * wide).sum(axis=1) - 2 * wide @ wide.T
    np.fill_diagonal(d, np.inf)
    rivals = d.argmin(axis=1)
    rows = []
    for k in range(queries):
        target, t = k % references, interpolations[k % len(interpolations)]
        noise = rng.normal(0, query_noise, dimensions)
        for halving in range(9):
            q = ((1 - t) * wide[target] + t * wide[rivals[target]] + noise / 2**halving).astype(np.float32)
            if ((wide - q) ** 2).sum(axis=1).argmin() == target:
                break
        else:
            raise ValueError("a query could not be placed nearest to its target")
        rows.append((k, q.tolist(), target))
    refs = spark.createDataFrame([(k, v.tolist(), k) for k, v in enumerate(x)], "ref_id bigint, vec array<float>, label int")
    return refs, spark.createDataFrame(rows, "query_id bigint, vec array<float>, label int")


def missing_labels(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Query labels that no reference has; empty for a valid dataset."""
    return queries.select("label").join(refs.select("label"), "label", "left_anti").distinct()


def inventory(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that are missing from ``found`` or extra in it, with their multiplicity, by ``problem``."""
    return expected.exceptAll(found).withColumn("problem", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("problem", F.lit("extra")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are not exactly once on both sides; empty for tables that align."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((left, "left_rows"), (right, "right_rows")))
    both = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_rows", "right_rows")])
    return both.where("left_rows != 1 or right_rows != 1")


def sample_parts(barcode: Column) -> Column:
    """participant and two-digit sample type of a barcode of the form AAAA-XX-XXXX-NNx; null if it is none."""
    good = barcode.rlike(r"^[^-]+-[^-]+-[^-]+-\d{2}")
    parts = F.split(barcode, "-")
    return F.when(good, F.struct(F.concat_ws("-", F.slice(parts, 1, 3)).alias("participant"), F.substring(F.get(parts, F.lit(3)), 1, 2).alias("sample_type")))


def image_parts(name: Column) -> Column:
    """object and angle of a file name of the form objN__A.ppm; null if it is none."""
    pattern = r"(?:^|/)obj(\d+)__(\d+)\.ppm$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("object"), F.regexp_extract(name, pattern, 2).cast("int").alias("angle")))


def kept_sample_types(samples: DataFrame, overrides: dict[str, list[str]] | None = None, default: tuple[str, ...] = ("01",)) -> DataFrame:
    """Samples whose type is wanted for their project: ``overrides`` by project, ``default`` elsewhere."""
    spark = samples.sparkSession
    rows = [(p, c) for p, codes in (overrides or {}).items() for c in codes]
    policy = spark.createDataFrame(rows, "project_id string, sample_type string")
    listed = policy.select("project_id").distinct()
    own = samples.join(F.broadcast(policy), ["project_id", "sample_type"], "left_semi")
    rest = samples.join(F.broadcast(listed), "project_id", "left_anti").where(F.col("sample_type").isin(list(default)))
    return own.unionByName(rest)
