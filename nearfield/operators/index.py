"""Nearest-neighbour indexes: exact, flat, uniform and hierarchical, for L1 and L2."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.operators import sampling, scan

FAMILIES = ("exact", "flat", "uniform", "hierarchical")


@dataclass(frozen=True)
class Settings:
    metric: str = "l2"
    family: str = "exact"
    repetitions: int = 0
    seed: int = 0
    projection_dimension: int = 0
    strategy: str = "automatic"

    def __post_init__(self):
        vectors.distance(self.metric)
        if self.family not in FAMILIES:
            raise ValueError(f"unknown index family {self.family!r}")
        if self.family == "hierarchical" and self.projection_dimension < 1:
            raise ValueError("the projection dimension must be 1 at least")
        if self.repetitions < 0:
            raise ValueError("repetitions can't be negative")


class NearestNeighborIndex:
    """Fitted to references by :meth:`fit`; :meth:`transform` then answers any set of queries."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.refs: DataFrame | None = None
        self.sample: DataFrame | None = None
        self.matrix: DataFrame | None = None
        self.reduced: DataFrame | None = None
        self._reduction: sampling.Reduction | None = None
        self._size: int | None = None

    def fit(self, refs: DataFrame, probs: DataFrame | None = None, sample: DataFrame | None = None, mass: float | None = None, policy: str = "blocked") -> NearestNeighborIndex:
        """Builds the index tables. ``sample`` is used as it is; otherwise one is drawn from ``probs``, which are
        computed by ``policy`` if they aren't given (uniform: from ``mass``)."""
        s = self.settings
        if refs.limit(1).count() == 0:
            raise ValueError("there are no references")
        self.refs = refs
        self._reduction = self._size = None
        if s.family == "exact":
            self.reduced = refs.select("ref_id", "vec")
            return self
        if sample is None:
            if s.family == "uniform":
                dimension = refs.select(F.size("vec")).first()[0]
                if mass is None:
                    mass = sampling.sampling_mass(sampling.importance_probabilities(refs, s.metric, policy)).first()[0]
                probs = sampling.uniform_probabilities(refs.sparkSession, mass, dimension)
            elif probs is None:
                probs = sampling.importance_probabilities(refs, s.metric, policy)
            sample = sampling.coordinate_sample(probs, s.repetitions, s.seed)
        self.sample = sampling.validated(sample).persist()
        if s.family == "hierarchical":
            if refs.limit(2).count() > 1 and self.sample.limit(1).count() == 0:
                raise ValueError("the coordinate sample is empty")
            self.matrix = sampling.projection(self.sample, s.metric, s.projection_dimension, s.seed).persist()
        reduced = self.reduction().of(refs.select("ref_id", "vec"), "ref_id")
        self.reduced = reduced.persist()
        return self

    def close(self) -> None:
        """Lets go of the index tables, which :meth:`fit` keeps so that each batch of queries finds them ready."""
        for table in (self.sample, self.matrix, self.reduced if self.sample is not None else None):
            if table is not None:
                table.unpersist()

    def reduction(self) -> sampling.Reduction:
        """What maps vectors to the index's own space, fetched once from the sample and the projection."""
        if self._reduction is None:
            self._reduction = sampling.Reduction.fetched(self.sample, self.settings.metric, self.matrix, self.settings.projection_dimension)
        return self._reduction

    def transform(self, queries: DataFrame) -> DataFrame:
        """(query_id, ref_id, dist) with dist in the index's own space; the lowest id wins ties.

        Sampling, projection and scan of a batch of queries are one pass in numpy, unless the strategy asks for
        expressions.
        """
        s, rows = self.settings, queries.select("query_id", "vec")
        if self._size is None:
            self._size = scan.measured(self.reduced)
        if s.family == "exact":
            return scan.nearest(rows, self.reduced, s.metric, s.strategy, size=self._size)
        own = self.reduction()
        kind = {"l2": "l2", "l1": "median" if s.family == "hierarchical" else "weighted_l1"}[s.metric]
        if s.strategy in ("array_scan", "relational") and self._size <= scan._BLOCK_BYTES:
            rows = sampling.projected(rows, self.sample, self.matrix) if s.family == "hierarchical" else sampling.embedded(rows, self.sample, s.metric)
            return scan.nearest(rows.select("query_id", "vec"), self.reduced, kind, s.strategy, own.weights, size=self._size)
        return scan.nearest(rows, self.reduced, kind, s.strategy, own.weights, own, self._size)

    def space_usage(self) -> DataFrame:
        """One row: index_bytes, workspace_bytes, unique_coordinates, total_multiplicity of the logical payload."""
        s = self.settings
        shape = self.refs.agg(F.count("*").alias("r"), F.max(F.size("vec")).cast("bigint").alias("d"))
        if s.family == "exact":
            sizes = [F.col("r") * F.col("d") * 4, F.lit(0).cast("bigint"), F.col("d"), F.col("d")]
        else:
            shape = shape.crossJoin(self.sample.agg(F.count("*").alias("i"), F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("m")))
            r, i, p = F.col("r"), F.col("i"), s.projection_dimension
            if s.family == "hierarchical":
                sizes = [i * 24 + i * 8 * p + r * 8 * p, i * 4 + p * 8 * (2 if s.metric == "l1" else 1)]
            elif s.metric == "l1":
                sizes = [i * 24 + r * i * 4, F.lit(0).cast("bigint")]
            else:
                sizes = [r * i * 4 + i * 12, i * 4]
            sizes += [i, F.col("m")]
        names = ("index_bytes", "workspace_bytes", "unique_coordinates", "total_multiplicity")
        return shape.select(*[x.alias(n) for x, n in zip(sizes, names, strict=True)])

    def save(self, path: str) -> None:
        """Writes the references and index tables as Parquet, and the settings; refuses to overwrite."""
        spark = self.refs.sparkSession
        tables = {"refs": self.refs, "reduced": self.reduced, "sample": self.sample, "matrix": self.matrix}
        for name, table in tables.items():
            if table is not None:
                table.write.parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(asdict(self.settings)), [n for n, t in tables.items() if t is not None])], "settings string, tables array<string>").coalesce(1).write.json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NearestNeighborIndex:
        row = spark.read.schema("settings string, tables array<string>").json(f"{path}/settings").first()
        out = cls(Settings(**json.loads(row["settings"])))
        for name in row["tables"]:
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out

    def with_strategy(self, strategy: str) -> NearestNeighborIndex:
        """The same index, scanned another way."""
        out = NearestNeighborIndex(replace(self.settings, strategy=strategy))
        out.refs, out.sample, out.matrix, out.reduced = self.refs, self.sample, self.matrix, self.reduced
        out._reduction, out._size = self._reduction, self._size
        return out


def exact(metric: str = "l2", strategy: str = "automatic") -> NearestNeighborIndex:
    return NearestNeighborIndex(Settings(metric, "exact", strategy=strategy))


def flat(metric: str, repetitions: int, seed: int, strategy: str = "automatic") -> NearestNeighborIndex:
    return NearestNeighborIndex(Settings(metric, "flat", repetitions, seed, strategy=strategy))


def uniform(metric: str, repetitions: int, seed: int, strategy: str = "automatic") -> NearestNeighborIndex:
    return NearestNeighborIndex(Settings(metric, "uniform", repetitions, seed, strategy=strategy))


def hierarchical(metric: str, repetitions: int, projection_dimension: int, seed: int, strategy: str = "automatic") -> NearestNeighborIndex:
    return NearestNeighborIndex(Settings(metric, "hierarchical", repetitions, seed, projection_dimension, strategy))
