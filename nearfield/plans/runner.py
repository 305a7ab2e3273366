"""Runs a setup: probabilities once, then every run, with quality diagnostics outside the timed part."""

from __future__ import annotations

import datetime
import json
import os
import platform
import time

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import metrics, sampling
from nearfield.operators.index import NearestNeighborIndex, Settings
from nearfield.plans.setup import FILES, SPARK_POLICY, SPARK_STRATEGY, Run, Setup
from nearfield.plans.summary import effective_batches
from nearfield.sources import storage


def probabilities(setup: Setup, refs: DataFrame) -> DataFrame:
    """The probability model that all approximate runs share, computed or loaded and checked against the references."""
    if setup.probability_policy == "load" and os.path.isfile(setup.probabilities):  # the binary form that the command line writes
        source = os.path.join(setup.dataset, {**FILES, **(setup.files or {})}["reference_vectors_file"])
        references, dimension = refs.agg(F.count("*"), F.max(F.size("vec"))).first()
        return storage.bound_probabilities(refs.sparkSession, setup.probabilities, setup.distance, references, dimension, storage.sha256_file(source))
    if setup.probability_policy == "load":
        return storage.load_probabilities(refs.sparkSession, setup.probabilities, setup.distance, refs)
    return sampling.importance_probabilities(refs, setup.distance, SPARK_POLICY[setup.probability_policy])


def build(run: Run, setup: Setup, refs: DataFrame, probs: DataFrame | None) -> NearestNeighborIndex:
    strategy = SPARK_STRATEGY[run.strategy]
    index = NearestNeighborIndex(Settings(setup.distance, run.index, run.repetitions or 0, run.seed or 0, run.projection_dimension or 0, strategy))
    if run.index == "uniform":
        return index.fit(refs, mass=sampling.sampling_mass(probs).first()[0])
    return index.fit(refs, probs)


def _timed(index: NearestNeighborIndex, queries: DataFrame) -> float:
    began = time.perf_counter()
    index.transform(queries).write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000


def run(setup: Setup, refs: DataFrame, queries: DataFrame) -> dict:
    """The report: settings, provenance and, for each run, trial times by batch size and the diagnostics asked for."""
    spark = refs.sparkSession
    if setup.max_queries:
        queries = queries.orderBy("query_id").limit(setup.max_queries)
    refs, queries = refs.cache(), queries.cache()
    total = queries.count()
    approximate = any(r.index != "exact" for r in setup.runs)
    probs = probabilities(setup, refs).cache() if approximate else None
    table = metrics.distance_table(queries, refs, setup.distance).cache() if setup.diagnostics == "full_distance_table" else None
    out, reference = [], None
    labelled = "label" in refs.columns and "label" in queries.columns
    for r in setup.ordered():
        index = build(r, setup, refs, probs)
        sizes = spark.range(1).select(effective_batches(F.lit(list(r.batch_sizes)), total)).first()[0]
        measured = []
        for size in sizes:  # a batch here is what one job answers; ids need not be dense
            part = queries.orderBy("query_id").limit(size)
            for _ in range(r.warmups):
                _timed(index, part)
            trials = [_timed(index, part) for _ in range(r.trials)]
            ranked = sorted(trials)
            median = (ranked[(len(trials) - 1) // 2] + ranked[len(trials) // 2]) / 2
            measured.append({"batch_size": size, "trial_ms": trials, "median_ms": median, "us_per_query": median * 1000 / size, "queries_per_second": size * 1000 / median})
        found = index.transform(queries).select("query_id", "ref_id").cache()
        reference = found if reference is None else reference
        row = {"name": r.name, "index": r.index, "backend": r.backend, "strategy": r.strategy, "repetitions": r.repetitions, "seed": r.seed, "projection_dimension": r.projection_dimension, "measurements": measured}
        row["space"] = index.space_usage().first().asDict()
        row["quality"] = metrics.basic_quality(found, reference, *((queries, refs) if labelled else ())).first().asDict()
        if table is not None:
            judged = metrics.judged(found, table).cache()
            row["approximation"] = metrics.evaluate(judged).first().asDict()
            row["approximation"]["epsilon_failures"] = [x.asDict() for x in metrics.epsilon_failures(judged).orderBy("epsilon").collect()]
            row["approximation"]["buckets"] = [x.asDict() for x in metrics.bucket_quality(judged).orderBy("bucket").collect()]
        elif setup.diagnostics == "selected_distances":
            judged = metrics.judged_selected(found, reference, queries, refs, setup.distance)
            row["approximation"] = metrics.evaluate(judged).first().asDict()
        out.append(row)
    report = {"schema_version": 6, "provenance": provenance(spark), "distance": setup.distance, "reference": setup.reference, "queries": total, "reference_vectors_digest": storage.digest(refs), "runs": out}
    if table is not None:
        optima = metrics.optima(table)
        report["geometry"] = metrics.geometry(optima).first().asDict() | {"buckets": [x.asDict() for x in metrics.buckets(optima).orderBy("bucket").collect()]}
    return report


def provenance(spark: SparkSession) -> dict:
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"generated_at_utc": now, "spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "host": platform.node(), "master": spark.sparkContext.master, "device": None}


def write_report(report: dict, json_path: str, csv_path: str) -> None:
    """Both outputs, each put in place at once."""
    rows = ["name,index,backend,strategy,repetitions,seed,projection_dimension,batch_size,trial,ms\n"]
    for r in report["runs"]:
        head = [r[k] for k in ("name", "index", "backend", "strategy", "repetitions", "seed", "projection_dimension")]
        for m in r["measurements"]:
            rows += [",".join("" if x is None else f"{x:.17g}" if isinstance(x, float) else str(x) for x in [*head, m["batch_size"], k, ms]) + "\n" for k, ms in enumerate(m["trial_ms"])]
    for path, text in ((json_path, json.dumps(report, indent=2)), (csv_path, "".join(rows))):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(path + ".new", path)


def validated(report: dict) -> dict:
    """The report itself; an error if it is of another schema or lacks its one exact reference."""
    if report.get("schema_version") != 6:
        raise ValueError("the report is of another schema")
    if [r["index"] for r in report["runs"] if r["name"] == report["reference"]] != ["exact"]:
        raise ValueError("the report needs one exact reference")
    return report
