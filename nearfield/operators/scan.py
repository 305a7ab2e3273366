"""Exact scans: the nearest reference of each query, lowest id on ties.

``refs`` has (ref_id, vec), ``queries`` has (query_id, vec) with ids that are unique. Queries are many and never move;
references are dealt by their measured size into blocks that are broadcast, and partial results of blocks are merged.
A null vector, one of another size or one with a value that is not finite is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.functions.shipping import ship

STRATEGIES = ("automatic", "array_scan", "relational", "parallel_references", "direct", "gemm")
Work = Callable[[pa.RecordBatch], Iterator[list[pa.Array]]]
KINDS = ("l1", "l2", "weighted_l1", "median")
_BLOCK_BYTES = 64 << 20  # of references in one broadcast, as doubles
_FEW = 1 << 10  # values of all references together up to which expressions are done before Python workers start
_CACHE = 1 << 16  # distances that are summed up together, so that they stay in a core's cache


def nearest(queries: DataFrame, refs: DataFrame, metric: str = "l2", strategy: str = "automatic", weights: np.ndarray | None = None, prepare: Callable[[np.ndarray], np.ndarray] | None = None, size: int | None = None) -> DataFrame:
    """(query_id, ref_id, dist) for each query; dist is what the metric (one of KINDS) ranks by.

    array_scan keeps all references in one broadcast row, relational joins a broadcast and aggregates; both are
    expressions and take sets of up to 64 MiB, larger ones go the way of direct. direct runs in numpy over blocks of
    references, with the same sums in the same order; parallel_references is direct with two blocks at least; gemm (L2
    only) is direct in single precision by the norm identity, so near ties can fall the other way. automatic takes
    array_scan for a thousand values, direct otherwise. ``weights`` are those of weighted_l1. ``prepare`` maps a
    matrix of queries to the references' space and is for the numpy strategies. ``size``: bytes, if known.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if metric not in KINDS:
        raise ValueError(f"unknown metric {metric!r}")
    if strategy == "gemm" and metric != "l2":
        raise ValueError(f"{metric} has no matrix product form")
    size = measured(refs) if size is None else size
    if strategy == "automatic":
        strategy = "array_scan" if prepare is None and size <= 8 * _FEW else "direct"
    if strategy in ("array_scan", "relational") and size <= _BLOCK_BYTES:
        return _expressions(queries, refs, metric, strategy, weights)
    blocks = max(2 if strategy == "parallel_references" else 1, blocks_for(size))
    held_back = queries.sparkSession.sparkContext.broadcast((prepare, weights))

    def work(ids: np.ndarray, held: np.ndarray) -> Work:
        prepare, weights = held_back.value
        of = _product(held) if strategy == "gemm" else summed(held, metric, weights)

        def run(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            picks, dists = [np.zeros(0, np.int64)], [np.zeros(0)]
            for d in of(prepared(batch, prepare)):
                best = d.argmin(axis=1)
                picks.append(ids[best])
                dists.append(d[np.arange(len(d)), best])
            yield [batch.column(0), pa.array(np.concatenate(picks), pa.int64()), pa.array(np.concatenate(dists), pa.float64())]

        return run

    parts = by_block(queries, refs, blocks, work, "query_id bigint, ref_id bigint, dist double")
    if len(parts) == 1:
        return parts[0]
    if queries.isStreaming:
        raise ValueError("a stream is scored against one block of references")
    return _best(reduce(DataFrame.unionAll, parts).groupBy("query_id").agg(F.min(F.struct("dist", "ref_id")).alias("best")))


def measured(refs: DataFrame) -> int:
    """Bytes of the vectors of ``refs`` as doubles."""
    return refs.agg(F.coalesce(F.sum(F.size("vec").cast("bigint") * 8), F.lit(0))).first()[0]


def blocks_for(size: int) -> int:
    """How many broadcasts a reference set of ``size`` bytes takes."""
    return max(1, -(-size // _BLOCK_BYTES))


def hinted(refs: DataFrame) -> DataFrame:
    """``refs`` for an equality join: with a broadcast hint if their measured size allows one."""
    return F.broadcast(refs) if blocks_for(measured(refs)) == 1 else refs


def by_block(queries: DataFrame, refs: DataFrame, blocks: int, work: Callable[[np.ndarray, np.ndarray], Work], schema: str, extra: tuple[str, ...] = ()) -> list[DataFrame]:
    """One DataFrame for each block of references: ``work(ids, matrix)`` is called once in a task and its result with
    each batch of (query_id, vec, ``extra``), to yield columns of ``schema``. The driver holds one block at a time."""
    spark = queries.sparkSession
    ship(spark)
    rows, names, out = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "vec", *extra), [c.split()[0] for c in schema.split(",")], []
    for block in range(blocks):
        ids, held = collected(refs if blocks == 1 else refs.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == block))
        if not len(ids):
            continue
        if not np.isfinite(held).all():
            raise ValueError("a reference has values that are not finite")
        shared = spark.sparkContext.broadcast((ids, held))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = work(*shared.value)
            for batch in batches:
                for columns in of(batch):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        out.append(rows.mapInArrow(run, schema))
    if not out:
        raise ValueError("there are no references")
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix; rows must be of one length and not null."""
    if column.null_count:
        raise ValueError("a vector is null")
    if len(column) and pc.min_max(pc.list_value_length(column)).as_py() != {"min": (n := pc.list_value_length(column[:1])[0].as_py()), "max": n}:
        raise ValueError("vector sizes differ")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def collected(refs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a reference set whose size has been checked, ordered by id."""
    table = refs.select("ref_id", "vec").toArrow()
    ids = table.column("ref_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table.column("vec").combine_chunks())[order]


def prepared(batch: pa.RecordBatch, prepare: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
    q = matrix(batch.column(1))
    if prepare is not None:
        return prepare(q) if len(q) else q
    if not np.isfinite(q).all():
        raise ValueError("a query has values that are not finite")
    return q


def summed(held: np.ndarray, kind: str, weights: np.ndarray | None = None) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
    """A function from queries to their distances to ``held``, some rows at a time.

    Coordinates are added one after another over many (query, reference) places at once: sums run left to right like
    those of the expressions, and nothing larger than the places is kept.
    """
    places = np.ascontiguousarray(held.T, dtype=np.float64)
    count, step = held.shape[0], max(1, _CACHE // max(1, held.shape[0]))

    def medians(q: np.ndarray) -> Iterator[np.ndarray]:
        n = held.shape[1]
        rows = max(1, (1 << 20) // max(1, held.size))
        for k in range(0, len(q), rows):
            gaps = np.abs(q[k : k + rows].astype(np.float64)[:, None, :] - held.astype(np.float64))
            gaps.partition((max(0, n // 2 - 1), n // 2), axis=2)
            high, low = gaps[:, :, n // 2], gaps[:, :, max(0, n // 2 - 1)]
            yield high if n % 2 else low + (high - low) * 0.5

    def sums(q: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(q), step):
            columns = np.ascontiguousarray(q[k : k + step].T, dtype=np.float64)
            total, gap = np.zeros((columns.shape[1], count)), np.empty((columns.shape[1], count))
            for j, own in enumerate(places):
                np.subtract(columns[j][:, None], own, out=gap)
                if kind == "l2":
                    np.multiply(gap, gap, out=gap)
                else:
                    np.abs(gap, out=gap)
                    if weights is not None:
                        np.multiply(gap, weights[j], out=gap)
                total += gap
            yield total

    def run(q: np.ndarray) -> Iterator[np.ndarray]:
        if len(q) and q.shape[1] != held.shape[1]:
            raise ValueError("vector sizes differ")
        return medians(q) if kind == "median" else sums(q)

    return run


def _product(held: np.ndarray) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
    narrow = held.astype(np.float32)
    norms = (narrow * narrow).sum(axis=1)
    step = max(1, (8 << 20) // max(1, held.shape[0]))

    def run(q: np.ndarray) -> Iterator[np.ndarray]:
        if len(q) and q.shape[1] != held.shape[1]:
            raise ValueError("vector sizes differ")
        for k in range(0, len(q), step):
            part = q[k : k + step].astype(np.float32)
            yield ((part * part).sum(axis=1)[:, None] + norms - 2 * (part @ narrow.T)).astype(np.float64)

    return run


def _expressions(queries: DataFrame, refs: DataFrame, metric: str, strategy: str, weights: np.ndarray | None) -> DataFrame:
    if metric == "weighted_l1":  # the weights are as many as coordinates were sampled: part of the plan
        of = lambda q, r: vectors.weighted_l1_distance(q, r, F.lit([float(w) for w in weights]) if len(weights) else F.array().cast("array<double>"))
    else:
        of = vectors.median_abs_difference if metric == "median" else vectors.distance(metric)
    rows = queries.select("query_id", vectors.checked_finite(F.col("vec"), "a query").alias("q"))
    held = refs.select("ref_id", vectors.checked_finite(F.col("vec"), "a reference").alias("vec"))
    if strategy == "relational":
        pairs = rows.crossJoin(F.broadcast(held))
        scored = pairs.select("query_id", F.struct(of(F.col("q"), F.col("vec")).alias("dist"), "ref_id").alias("best"))
        return _best(scored.groupBy("query_id").agg(F.min("best").alias("best")))
    row = held.agg(F.sort_array(F.collect_list(F.struct("ref_id", "vec"))).alias("refs"))
    return _best(rows.crossJoin(F.broadcast(row)).select("query_id", _least(F.col("q"), F.col("refs"), of).alias("best")))


def _least(vec: Column, refs: Column, of) -> Column:
    return F.array_min(F.transform(refs, lambda r: F.struct(of(vec, r["vec"]).alias("dist"), r["ref_id"].alias("ref_id"))))


def _best(df: DataFrame) -> DataFrame:
    return df.select("query_id", "best.ref_id", "best.dist")
