"""Distance tables, query geometry and the quality of predictions.

Statistics are null where they have no rows. Quantiles are nearest-rank: the ceil(p * n)-th smallest value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.operators import scan

#: Approximation thresholds and lower bounds of the margin buckets.
EPSILONS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10)
MARGIN_BOUNDS = (1.0, 1.01, 1.05, 1.10, 1.25)
_INF = float("inf")


def distance_table(queries: DataFrame, refs: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, ref_id, dist) of every query with every reference; dist as reported (L2 with its root)."""
    vectors.distance(metric)

    def work(ids: np.ndarray, held: np.ndarray) -> scan.Work:
        of = scan.summed(held, metric)

        def run(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            queries_, at = batch.column(0).to_numpy(), 0
            for d in of(scan.prepared(batch, None)):
                own = queries_[at : at + len(d)]
                at += len(d)
                yield [pa.array(np.repeat(own, len(ids))), pa.array(np.tile(ids, len(d))), pa.array((d if metric == "l1" else np.sqrt(d)).ravel())]

        return run

    return reduce(DataFrame.unionAll, scan.by_block(queries, refs, scan.blocks_for(scan.measured(refs)), work, "query_id bigint, ref_id bigint, dist double"))


def margin(optimum: Column, second: Column) -> Column:
    """second / optimum; 1 if both are zero, else infinite if the optimum is."""
    return F.when(optimum > 0, second / F.when(optimum > 0, optimum)).when(second == 0, F.lit(1.0)).otherwise(F.lit(_INF))


def margin_bucket(value: Column) -> Column:
    """0 for [1, 1.01) up to 4 for [1.25, inf]."""
    out = F.lit(0)
    for k, bound in enumerate(MARGIN_BOUNDS[1:], 1):
        out = F.when(value >= bound, k).otherwise(out)
    return out


def optima(table: DataFrame) -> DataFrame:
    """(query_id, optimum, second, multiplicity, margin, bucket) of a distance table.

    second is the least distance without the first nearest reference, so it equals the optimum on ties; it is
    infinite where there is one reference.
    """
    ranked = table.groupBy("query_id").agg(F.sort_array(F.collect_list("dist")).alias("d"))
    return _margins(ranked.select("query_id", *_least("d")))


def _least(ranked: str) -> list[Column]:
    """Optimum, second and multiplicity from a query's distances in order."""
    first = F.get(ranked, 0)
    return [first.alias("optimum"), F.coalesce(F.get(ranked, 1), F.lit(_INF)).alias("second"), F.size(F.filter(ranked, lambda x: x == first)).cast("bigint").alias("multiplicity")]


def _margins(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("margin", margin(F.col("optimum"), F.col("second")))
    return out.withColumn("bucket", margin_bucket(F.col("margin")))


def optima_of(queries: DataFrame, refs: DataFrame, metric: str = "l2") -> DataFrame:
    """As :func:`optima` without a distance table: one pass over the queries for each block of references."""
    return _margins(_assessed(queries, refs, metric).select("query_id", "optimum", "second", "multiplicity"))


def judged_of(predictions: DataFrame, queries: DataFrame, refs: DataFrame, metric: str = "l2") -> DataFrame:
    """As :func:`judged` without a distance table: the predicted reference's vector travels with its query."""
    rows = queries.select("query_id", "vec").join(predictions.select("query_id", F.col("ref_id").alias("got")), "query_id")
    rows = rows.join(scan.hinted(refs).select(F.col("ref_id").cast("bigint").alias("got"), F.col("vec").alias("got_vec")), "got")
    return _judged(_margins(_assessed(rows, refs, metric, ("got", "got_vec")).withColumnRenamed("got", "ref_id")))


def _assessed(rows: DataFrame, refs: DataFrame, metric: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, optimum, second, multiplicity), with ``extra`` also got, returned and nearer; blocks' parts are merged."""
    vectors.distance(metric)
    schema = "query_id bigint, optimum double, second double, multiplicity bigint" + (", got bigint, returned double, nearer bigint" if extra else "")

    def work(ids: np.ndarray, held: np.ndarray) -> scan.Work:
        of = scan.summed(held, metric)

        def run(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            vecs, at = scan.prepared(batch, None), 0
            if extra and len(batch):
                gaps = np.abs(vecs.astype(np.float64) - scan.matrix(batch.column(3)))
                terms = gaps if metric == "l1" else gaps * gaps
                returned = np.add.accumulate(terms, axis=1)[:, -1]
                returned = returned if metric == "l1" else np.sqrt(returned)
            for d in of(vecs):
                d = d if metric == "l1" else np.sqrt(d)
                two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.column_stack([d[:, 0], np.full(len(d), np.inf)])
                columns = [batch.column(0).slice(at, len(d)), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array((d == two[:, :1]).sum(axis=1))]
                if extra:
                    own = returned[at : at + len(d)]
                    columns += [batch.column(2).slice(at, len(d)), pa.array(own), pa.array((d < own[:, None]).sum(axis=1))]
                at += len(d)
                yield columns

        return run

    parts = scan.by_block(rows, refs, scan.blocks_for(scan.measured(refs)), work, schema, extra)
    if len(parts) == 1:
        return parts[0]
    by = ["query_id", *(["got", "returned"] if extra else [])]
    merged = reduce(DataFrame.unionAll, parts).groupBy(*by).agg(
        F.sort_array(F.flatten(F.collect_list(F.array("optimum", "second")))).alias("d"),
        F.collect_list(F.struct("optimum", "multiplicity")).alias("m"),
        *([F.sum("nearer").alias("nearer")] if extra else []),
    )
    equal = F.aggregate(F.filter("m", lambda x: x["optimum"] == F.get("d", 0)), F.lit(0).cast("bigint"), lambda n, x: n + x["multiplicity"])
    return merged.select(*by, F.get("d", 0).alias("optimum"), F.get("d", 1).alias("second"), equal.alias("multiplicity"), *(["nearer"] if extra else []))


def quantile(p: float, value: str) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def summary(df: DataFrame, value: str = "value") -> DataFrame:
    """count, mean, median, p95, p99 and max of a column, as one row; nulls are left out."""
    return df.where(F.col(value).isNotNull()).agg(*_summary(value))


def _summary(value: str, prefix: str = "") -> list[Column]:
    return [
        F.count(value).alias(prefix + "count"),
        F.avg(value).alias(prefix + "mean"),
        quantile(0.5, value).alias(prefix + "median"),
        quantile(0.95, value).alias(prefix + "p95"),
        quantile(0.99, value).alias(prefix + "p99"),
        F.max(value).alias(prefix + "max"),
    ]


def geometry(per_query: DataFrame) -> DataFrame:
    """One row about :func:`optima`: queries, zero optima, ties, infinite margins and the finite margins' summary."""
    finite = F.when(F.col("margin") < _INF, F.col("margin"))
    return per_query.withColumn("finite", finite).agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("optimum") == 0).alias("zero_optimum"),
        F.count_if(F.col("multiplicity") > 1).alias("non_unique"),
        F.count_if(F.col("margin") == _INF).alias("infinite_margins"),
        *_summary("finite", "margin_"),
    )


def buckets(per_query: DataFrame) -> DataFrame:
    """(bucket, queries) for all five margin buckets, empty ones too."""
    spark = per_query.sparkSession
    counts = per_query.groupBy("bucket").agg(F.count("*").alias("n"))
    return spark.range(len(MARGIN_BOUNDS)).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("queries"))


def judged(predictions: DataFrame, table: DataFrame) -> DataFrame:
    """Per query: returned distance, optimum, rank, ratio (null for a zero optimum), optimal, margin bucket.

    A prediction is optimal if its distance equals the optimum; its rank is one more than the number of references
    that are nearer.
    """
    rows = table.withColumnRenamed("ref_id", "other").join(predictions.select("query_id", "ref_id"), "query_id")
    rows = rows.groupBy("query_id", "ref_id").agg(F.sort_array(F.collect_list("dist")).alias("d"), F.max(F.when(F.col("other") == F.col("ref_id"), F.col("dist"))).alias("returned"))
    nearer = F.size(F.filter("d", lambda x: x < F.col("returned"))).cast("bigint")
    return _judged(_margins(rows.where("returned is not null").select("query_id", "ref_id", "returned", nearer.alias("nearer"), *_least("d"))))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "ref_id", "returned", "optimum", (F.col("nearer") + 1).alias("rank"), ratio(F.col("returned"), F.col("optimum")).alias("ratio"), (F.col("returned") == F.col("optimum")).alias("optimal"), "margin", "bucket")


def ratio(returned: Column, optimum: Column) -> Column:
    return F.when(optimum > 0, returned / F.when(optimum > 0, optimum))


def violates(epsilon: float) -> Column:
    """Over 1 + epsilon times the optimum; with a zero optimum, not optimal."""
    return F.when(F.col("optimum") == 0, ~F.col("optimal")).otherwise(F.col("ratio") > 1 + epsilon)


def evaluate(rows: DataFrame) -> DataFrame:
    """One row about :func:`judged` (or :func:`judged_selected`, which has no ranks)."""
    worse = F.when(~F.col("optimal"), F.col("ratio"))
    ranks = [F.avg("rank").alias("rank_mean"), quantile(0.95, "rank").alias("rank_p95")] if "rank" in rows.columns else []
    better = [F.count_if("better").alias("improvements")] if "better" in rows.columns else []
    return rows.agg(
        F.count("*").alias("queries"),
        F.count_if("optimal").alias("optimal"),
        F.count_if(~F.col("optimal")).alias("non_optimal"),
        F.count_if((F.col("optimum") == 0) & ~F.col("optimal")).alias("zero_optimum_misses"),
        *_summary("ratio", "ratio_"),
        F.avg(worse).alias("non_optimal_ratio_mean"),
        *ranks,
        *better,
    )


def epsilon_failures(rows: DataFrame) -> DataFrame:
    """(epsilon, violations, rate) for each threshold."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(violates(e)).alias(f"v{k}") for k, e in enumerate(EPSILONS)])
    parts = F.array(*[F.struct(F.lit(e).alias("epsilon"), F.col(f"v{k}").alias("violations")) for k, e in enumerate(EPSILONS)])
    return counts.select("n", F.explode(parts).alias("x")).select("x.epsilon", "x.violations", F.when(F.col("n") > 0, F.col("x.violations") / F.col("n")).alias("rate"))


def bucket_quality(rows: DataFrame) -> DataFrame:
    """(bucket, queries, errors, ratio_mean) for all margin buckets."""
    spark = rows.sparkSession
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(~F.col("optimal")).alias("errors"), F.avg("ratio").alias("ratio_mean"))
    every = spark.range(len(MARGIN_BOUNDS)).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left")
    return every.select("bucket", F.coalesce("n", F.lit(0)).alias("queries"), F.coalesce("errors", F.lit(0)).alias("errors"), "ratio_mean")


def judged_selected(predictions: DataFrame, reference: DataFrame, queries: DataFrame, refs: DataFrame, metric: str = "l2") -> DataFrame:
    """As :func:`judged` from two distances a query only: those of the prediction and of the reference prediction.

    Here optimal means at most as far as the reference's; nearer than that is an improvement. No ranks, no margins.
    """
    of, vecs = vectors.reported(metric), scan.hinted(refs).select("ref_id", F.col("vec").alias("r"))

    def dist(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("query_id", "ref_id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id").join(vecs, "ref_id").select("query_id", F.col("ref_id").alias(f"{name}_id"), of(F.col("q"), F.col("r")).alias(name))

    rows = dist(predictions, "returned").join(dist(reference, "optimum"), "query_id")
    r, o = F.col("returned"), F.col("optimum")
    return rows.select("query_id", F.col("returned_id").alias("ref_id"), "returned", "optimum", ratio(r, o).alias("ratio"), (r <= o).alias("optimal"), (r < o).alias("better"))


def basic_quality(predictions: DataFrame, reference: DataFrame, queries: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Agreement by id with the reference and, if both sides have labels, by label with it and with the truth."""
    rows = predictions.select("query_id", F.col("ref_id").alias("got")).join(reference.select("query_id", F.col("ref_id").alias("exact")), "query_id")
    out = [F.count("*").alias("queries"), F.count_if(F.col("got") == F.col("exact")).alias("agreeing")]
    if queries is None or refs is None:
        null = F.lit(None).cast("bigint")
        return rows.agg(*out, null.alias("label_correct"), null.alias("label_agreeing"))
    labels = refs.select("ref_id", "label")
    rows = rows.join(queries.select("query_id", F.col("label").alias("truth")), "query_id")
    rows = rows.join(labels.toDF("got", "got_label"), "got").join(labels.toDF("exact", "exact_label"), "exact")
    return rows.agg(*out, F.count_if(F.col("got_label") == F.col("truth")).alias("label_correct"), F.count_if(F.col("got_label") == F.col("exact_label")).alias("label_agreeing"))
