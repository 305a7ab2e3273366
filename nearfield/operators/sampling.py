"""Coordinate probabilities, samples and the embeddings and projections made from them.

Probabilities are (j, prob) for every coordinate, samples are (j, multiplicity, inv_prob) for those drawn. Draws are
hashes of (stream, seed, coordinate, repetition), so they do not depend on partitions and grow with repetitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.functions.shipping import ship
from nearfield.functions.vectors import hashed_uniform
from nearfield.operators.scan import collected, matrix, measured

POLICIES = ("relational", "blocked", "gram")
_BROADCAST_BYTES = 1 << 30


def long_form(df: DataFrame, id_col: str = "ref_id") -> DataFrame:
    """(id, j, v): one row per coordinate."""
    return df.select(id_col, F.posexplode("vec").alias("j", "v"))


def importance_probabilities(refs: DataFrame, metric: str = "l2", policy: str = "blocked", rows_per_block: int = 32) -> DataFrame:
    """(j, prob): the largest share that coordinate j has in the distance of a pair of different references.

    Zero for fewer than two references; pairs that are equal are left out; at most 1. blocked and gram work in numpy
    on pairs of references (gram: distances by a matrix product, with near-cancelled pairs computed again) and shuffle
    one maximum per coordinate and task: up to 1 GiB by a broadcast of the matrix, beyond that by groups that hold two
    blocks of rows each. relational is one self-join by coordinate, for a few references only.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    if policy == "gram" and metric == "l1":
        raise ValueError("l1 has no matrix product form")
    if policy != "relational":
        return _blocked(refs, metric, policy, rows_per_block)
    cells = long_form(refs)
    every = cells.select("j").distinct()
    gap = F.abs(F.col("a.v").cast("double") - F.col("b.v").cast("double"))
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.j") == F.col("b.j")) & (F.col("a.ref_id") < F.col("b.ref_id")))
    pairs = pairs.select(F.col("a.ref_id").alias("p"), F.col("b.ref_id").alias("q"), F.col("a.j").alias("j"), (gap if metric == "l1" else gap * gap).alias("part"))
    ids = refs.select("ref_id", "vec")
    whole = ids.alias("a").join(ids.alias("b"), F.col("a.ref_id") < F.col("b.ref_id")).select(F.col("a.ref_id").alias("p"), F.col("b.ref_id").alias("q"), vectors.distance(metric)(F.col("a.vec"), F.col("b.vec")).alias("whole"))
    shares = pairs.join(whole.where("whole > 0"), ["p", "q"]).groupBy("j").agg(F.max(F.col("part") * F.try_divide(F.lit(1.0), F.col("whole"))).alias("prob"))
    return every.join(shares, "j", "left").select("j", F.least(F.lit(1.0), F.coalesce("prob", F.lit(0.0))).alias("prob"))


def _shares(x: np.ndarray, own: range, later, metric: str, policy: str, best: np.ndarray) -> None:
    """Raises ``best`` to the shares of the pairs of each row in ``own`` with those from ``later(row)`` on."""
    norms = (x * x).sum(axis=1) if policy == "gram" else None
    step = max(1, (1 << 20) // max(1, x.shape[1]))
    for i in own:
        for k in range(later(i), len(x), step):
            parts = np.abs(x[k : k + step] - x[i])
            if metric == "l2":
                parts *= parts
            if norms is not None:
                inner = x[k : k + step] @ x[i]
                whole = norms[k : k + step] + norms[i] - 2 * inner
                unsure = whole <= 256 * np.finfo(np.float32).eps * (norms[k : k + step] + norms[i] + 2 * np.abs(inner))
                whole[unsure] = parts[unsure].sum(axis=1)
            else:  # left to right, as the expressions add
                whole = np.add.accumulate(parts, axis=1)[:, -1] if parts.shape[1] else np.zeros(len(parts))
            inverse = np.divide(1.0, whole, out=np.zeros_like(whole), where=whole > 0)
            np.maximum(best, (parts * inverse[:, None]).max(axis=0), out=best)


def _blocked(refs: DataFrame, metric: str, policy: str, step: int) -> DataFrame:
    spark = refs.sparkSession
    ship(spark)
    size = measured(refs)
    if size > _BROADCAST_BYTES:
        return _highest(_paired(refs, metric, policy, size))
    _, matrix = collected(refs)
    shared = spark.sparkContext.broadcast(matrix)
    blocks = max(1, -(-len(matrix) // step))
    dimension = matrix.shape[1] if len(matrix) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value.astype(np.float64)
        best = np.zeros(dimension)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                _shares(x, range(block * step, min(len(x), (block + 1) * step)), lambda i: i + 1, metric, policy, best)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension), pa.int32()), pa.array(best)], names=["j", "prob"])

    return _highest(spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "j int, prob double"))


def _highest(found: DataFrame) -> DataFrame:
    return found.groupBy("j").agg(F.least(F.lit(1.0), F.max("prob")).alias("prob"))


def _paired(refs: DataFrame, metric: str, policy: str, size: int, block_bytes: int = 64 << 20) -> DataFrame:
    """As the broadcast way, for any number of references: each pair of blocks of rows is a group of its own, of
    2 * ``block_bytes`` or so, and every pair of rows is in one group's charge. A row is sent once to each block."""
    blocks = max(1, -(-size // block_bytes))
    rows = refs.select("ref_id", "vec", F.pmod(F.xxhash64("ref_id"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.select("vec", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("own").combine_chunks()
        x, own = matrix(rows.column("vec").combine_chunks()).astype(np.float64), rows.column("own").to_numpy()
        best = np.zeros(x.shape[1])
        first = int((own == own[0]).sum()) if rows.column("low")[0] != rows.column("high")[0] else 0
        if first == 0:  # a block with itself
            _shares(x, range(len(x)), lambda i: i + 1, metric, policy, best)
        elif own[0] != own[-1]:
            _shares(x, range(first), lambda i: first, metric, policy, best)
        return pa.table({"j": pa.array(np.arange(len(best)), pa.int32()), "prob": pa.array(best)})

    return rows.groupBy("low", "high").applyInArrow(run, "j int, prob double")


def checked(probs: DataFrame) -> DataFrame:
    """``probs`` itself; an error where a probability is not in [0, 1]."""
    good = F.col("prob").isNotNull() & ~F.isnan("prob") & F.col("prob").between(0, 1)
    return probs.withColumn("prob", F.when(good, F.col("prob")).otherwise(F.raise_error(F.lit("a probability is not in [0, 1]")).cast("double")))


def sampling_mass(probs: DataFrame) -> DataFrame:
    """One row: the sum of the probabilities."""
    return checked(probs).agg(F.coalesce(F.sum("prob"), F.lit(0.0)).alias("mass"))


def uniform_probabilities(spark: SparkSession, mass: float, dimension: int) -> DataFrame:
    """mass / dimension for each coordinate; the mass must lie between 0 and the dimension."""
    if not 0 <= mass <= dimension:
        raise ValueError("the sampling mass must lie between 0 and the dimension")
    return spark.range(dimension).select(F.col("id").cast("int").alias("j"), F.lit(mass / dimension if dimension else 0.0).alias("prob"))


def coordinate_sample(probs: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """(j, multiplicity, inv_prob) of the coordinates drawn at least once in ``repetitions`` independent rounds."""
    rounds = F.sequence(F.lit(1), F.lit(repetitions)) if repetitions > 0 else F.array().cast("array<int>")
    drawn = F.size(F.filter(rounds, lambda t: hashed_uniform("sample", seed, F.col("j"), t) < F.col("prob")))
    rows = checked(probs).where("prob > 0").select("j", drawn.cast("bigint").alias("multiplicity"), F.try_divide(F.lit(1.0), F.col("prob")).alias("inv_prob"))
    return rows.where("multiplicity > 0")


def validated(sample: DataFrame, dimension: int | None = None) -> DataFrame:
    """``sample`` itself; an error for a multiplicity under 1, a bad inverse probability or a place out of range."""
    good = (F.col("multiplicity") > 0) & (F.col("inv_prob") > 0) & (F.col("inv_prob") < float("inf")) & (F.col("j") >= 0)
    if dimension is not None:
        good = good & (F.col("j") < dimension)
    return sample.withColumn("multiplicity", F.when(good, F.col("multiplicity")).otherwise(F.raise_error(F.lit("the coordinate sample is not valid")).cast("bigint")))


def as_row(sample: DataFrame) -> DataFrame:
    """A sample as one row of arrays in order of the coordinate: places, multiplicities, inv_probs. Empty is a row too."""
    rows = sample.agg(F.sort_array(F.collect_list(F.struct("j", "multiplicity", "inv_prob"))).alias("s"))
    return rows.select(F.col("s.j").cast("array<int>").alias("places"), F.col("s.multiplicity").alias("multiplicities"), F.col("s.inv_prob").alias("inv_probs"))


def scales() -> Column:
    """L2 scale of each sampled coordinate, in single precision."""
    return F.zip_with("multiplicities", "inv_probs", lambda m, p: vectors.narrowed(F.sqrt(m * p)))


def weights() -> Column:
    """L1 weight of each sampled coordinate."""
    return F.zip_with("multiplicities", "inv_probs", lambda m, p: m * p)


def embedded(df: DataFrame, sample: DataFrame, metric: str) -> DataFrame:
    """``df`` with vec replaced by its sampled coordinates: scaled in single precision for L2, plain for L1."""
    row = as_row(sample)
    row = row.select("places", (scales() if metric == "l2" else weights()).alias("_w"))
    wide = df.crossJoin(F.broadcast(row))
    wide = wide.withColumn("_own", vectors.gather(F.col("vec"), F.col("places")))
    own = vectors.checked_finite(F.col("_own"), "a sampled vector").cast("array<float>")
    vec = F.zip_with(own, F.col("_w"), lambda v, s: v * s) if metric == "l2" else own
    kept = [c for c in df.columns if c != "vec"]
    out = wide.select(*kept, vec.alias("vec"), *([] if metric == "l2" else [F.col("_w").alias("weights")]))
    return out


def projection(sample: DataFrame, metric: str, dimension: int, seed: int) -> DataFrame:
    """(k, j, coef): a random matrix of ``dimension`` rows over the sampled coordinates.

    L2: random signs, summed over the multiplicity, times sqrt(inv_prob / dimension). L1: Cauchy times the weight.
    """
    if dimension < 1:
        raise ValueError("the projection dimension must be 1 at least")
    cells = sample.crossJoin(sample.sparkSession.range(dimension).select(F.col("id").cast("int").alias("k")))
    if metric == "l2":
        ups = F.size(F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("multiplicity")), lambda t: hashed_uniform("sign", seed, F.col("k"), F.col("j"), t) < 0.5))
        coef = (2 * ups - F.col("multiplicity")) * F.sqrt("inv_prob") * F.lit(1.0 / dimension**0.5)
    else:
        u = (hashed_uniform("cauchy", seed, F.col("k"), F.col("j")) * float(1 << 52) + 0.5) / float(1 << 52)
        coef = F.tan(F.pi() * (u - 0.5)) * F.col("inv_prob") * F.col("multiplicity")
    return cells.select("k", "j", coef.alias("coef"))


def projected(df: DataFrame, sample: DataFrame, matrix: DataFrame) -> DataFrame:
    """``df`` with vec replaced by its projection: one dot product of sampled coordinates for each row of the matrix."""
    rows = matrix.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("j", "coef"))).alias("r"))
    row = rows.agg(F.sort_array(F.collect_list(F.struct("k", F.col("r.coef").alias("coefs")))).alias("m")).select(F.col("m.coefs").alias("_m"))
    wide = df.crossJoin(F.broadcast(as_row(sample).select("places"))).crossJoin(F.broadcast(row))
    kept = [c for c in df.columns if c != "vec"]
    # each step is a column of its own, so that no expression is worked out twice
    wide = wide.withColumn("_own", vectors.gather(F.col("vec"), F.col("places")))
    wide = wide.withColumn("_own", vectors.checked_finite(F.col("_own"), "a sampled vector"))
    wide = wide.withColumn("_vec", F.transform("_m", lambda r: vectors.dot(r, F.col("_own"))))
    return wide.select(*kept, vectors.checked_finite(F.col("_vec"), "a projection").alias("vec"))


@dataclass(frozen=True)
class Reduction:
    """A coordinate sample, and a projection if there is one, as arrays: maps matrices of vectors in numpy.

    ``scales`` multiply the sampled coordinates (flat L2); ``weights`` go beside them (flat L1); ``coefs`` has a row for
    each dimension of a projection.
    """

    places: np.ndarray
    scales: np.ndarray | None = None
    weights: np.ndarray | None = None
    coefs: np.ndarray | None = None

    @classmethod
    def fetched(cls, sample: DataFrame, metric: str, matrix_: DataFrame | None = None, dimension: int = 0) -> Reduction:
        """From a sample, which has at most a row for each coordinate, and a projection, whose size is checked."""
        drawn = sample.select("j", "multiplicity", "inv_prob").toArrow().sort_by("j")
        places, weights = drawn.column("j").to_numpy().astype(np.int64), drawn.column("multiplicity").to_numpy() * drawn.column("inv_prob").to_numpy()
        if matrix_ is not None:
            if 8 * dimension * len(places) > _BROADCAST_BYTES:
                raise ValueError("the projection is too large to broadcast: take fewer repetitions or dimensions")
            rows = matrix_.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("j", "coef"))).alias("r")).select("k", "r.coef").toArrow()
            order = np.argsort(rows.column("k").to_numpy())
            return cls(places, coefs=matrix(rows.column("coef").combine_chunks())[order] if len(places) else np.zeros((dimension, 0)))
        if metric == "l1":
            return cls(places, weights=weights)
        scales = np.sqrt(weights)
        if len(scales) and scales.max() > np.finfo(np.float32).max:
            raise ValueError("value is too large for a float")
        return cls(places, scales=scales.astype(np.float32))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(self.places) and self.places[-1] >= x.shape[1]:
            raise ValueError("vector sizes differ: a sampled coordinate is out of range")
        own = x[:, self.places]
        if not np.isfinite(own).all():
            raise ValueError("a sampled vector has values that are not finite")
        if self.coefs is not None:
            own = own.astype(np.float64) @ self.coefs.T
            if not np.isfinite(own).all():
                raise ValueError("a projection has values that are not finite")
            return own
        own = own.astype(np.float32)
        return own if self.scales is None else own * self.scales

    def of(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, vec) of ``df`` with vec mapped; batches of vectors at a time."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)
        kind = "float" if self.coefs is None else "double"
        element = pa.float32() if self.coefs is None else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                out = shared.value(matrix(batch.column(1)))
                ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel(), element))], names=[id_col, "vec"])

        return df.select(F.col(id_col).cast("bigint").alias(id_col), "vec").mapInArrow(run, f"{id_col} bigint, vec array<{kind}>")
