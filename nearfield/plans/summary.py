"""Aggregation of benchmark runs: across seeds, flat against hierarchical, Pareto frontiers, joined reports.

A run is a row with name, index, metric, backend, strategy, repetitions, projection_dimension, seed, batch_size,
us_per_query, agreement, index_bytes, unique_coordinates and total_multiplicity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUES = ("us_per_query", "agreement", "index_bytes", "unique_coordinates", "total_multiplicity")


def rates(median_ms: Column, queries: Column) -> list[Column]:
    """us_per_query and queries_per_second of a batch; null where they can't be told."""
    return [F.try_divide(median_ms * 1000, queries).alias("us_per_query"), F.try_divide(queries * 1000, median_ms).alias("queries_per_second")]


def median_ms(trials: Column) -> Column:
    """Median of an array of trials, the mean of the middle two if even."""
    ranked, n = F.array_sort(trials), F.size(trials)
    return F.when(n > 0, (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2)


def with_exact(runs: DataFrame, dimension: int) -> DataFrame:
    """Approximate runs beside the exact run of their batch size: deltas, speed-up, shares and compression."""
    exact = runs.where("index = 'exact'").groupBy("batch_size").agg(F.min("us_per_query").alias("exact_us"), F.min("index_bytes").alias("exact_bytes"))
    rows = runs.where("index != 'exact'").join(F.broadcast(exact), "batch_size", "left")
    return rows.withColumns(
        {
            "delta_us": F.col("us_per_query") - F.col("exact_us"),
            "speedup": F.try_divide("exact_us", "us_per_query"),
            "dimension_fraction": F.col("unique_coordinates") / F.lit(dimension),
            "mass_estimate": F.try_divide("total_multiplicity", "repetitions"),
            "compression": F.when(F.col("index_bytes") > 0, F.col("exact_bytes") / F.col("index_bytes")),
        }
    )


def across_seeds(runs: DataFrame, by: list[str], values: tuple[str, ...] = VALUES) -> DataFrame:
    """By configuration: the number of runs, their seeds, and mean, sample deviation (0 for one run), min and max."""
    out = [F.count("*").alias("runs"), F.array_sort(F.collect_set("seed")).alias("seeds")]
    for v in values:
        spread = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
        out += [F.avg(v).alias(f"{v}_mean"), spread.alias(f"{v}_stddev"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return runs.groupBy(*by).agg(*out)


def _quotient(a: Column, b: Column) -> Column:
    """a / b of numbers that may be zero, as floating point has it: infinite over zero, NaN for zero over zero."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def hierarchical_against_flat(runs: DataFrame) -> DataFrame:
    """Each hierarchical run beside the flat run with the same draws; they must have sampled the same coordinates. Over
    a flat run of no bytes size_ratio is infinite, or NaN."""
    keys = ["repetitions", "seed", "backend", "strategy", "batch_size"]
    pick = [*keys, *VALUES]
    flat = runs.where("index = 'flat'").select(*keys, *[F.col(v).alias(f"flat_{v}") for v in VALUES])
    rows = runs.where("index = 'hierarchical'").select("name", "projection_dimension", *pick).join(flat, keys)
    same = (F.col("unique_coordinates") == F.col("flat_unique_coordinates")) & (F.col("total_multiplicity") == F.col("flat_total_multiplicity"))
    delta = F.when(same, F.col("us_per_query") - F.col("flat_us_per_query")).otherwise(F.raise_error(F.lit("a hierarchical run has other coordinates than its flat run")).cast("double"))
    return rows.select("name", "projection_dimension", *keys, delta.alias("delta_us"), (F.col("agreement") - F.col("flat_agreement")).alias("delta_agreement"), _quotient(F.col("index_bytes"), F.col("flat_index_bytes")).alias("size_ratio"))


def pareto(runs: DataFrame, cost: str, value: str, larger_is_better: bool, by: list[str] | None = None) -> DataFrame:
    """The runs that no cheaper run matches in value, from cheap to dear; among equal costs the best value counts."""
    order = [F.col(cost), F.desc(value) if larger_is_better else F.col(value)]
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = (F.max if larger_is_better else F.min)(value).over(before)
    better = seen.isNull() | ((F.col(value) > seen) if larger_is_better else (F.col(value) < seen))
    return runs.withColumn("_better", better).where("_better").drop("_better")


def excess_percent(ratio: Column) -> Column:
    return 100 * (ratio - 1)


def joined(reports: list[DataFrame], key: str = "name") -> DataFrame:
    """The runs of several reports as one; the exact reference's trials are put together, other names must differ.

    Reports have (name, reference boolean, batch_size, trial_ms array); the result adds median_ms.
    """
    rows = reports[0]
    for r in reports[1:]:
        rows = rows.unionByName(r)
    out = rows.groupBy(key, "reference", "batch_size").agg(F.flatten(F.collect_list("trial_ms")).alias("trial_ms"), F.count("*").alias("_n"))
    once = F.when(F.col("reference") | (F.col("_n") == 1), F.col("trial_ms")).otherwise(F.raise_error(F.lit("two reports have a run of the same name")).cast("array<double>"))
    return out.withColumn("trial_ms", once).withColumn("median_ms", median_ms(F.col("trial_ms"))).drop("_n")


def trial_rows(runs: DataFrame) -> DataFrame:
    """One row per trial: the CSV form of a report."""
    return runs.select("name", "batch_size", F.posexplode("trial_ms").alias("trial", "ms"))


def renumbered(trials: DataFrame) -> DataFrame:
    """Trials of joined reports counted anew within each run and batch size."""
    order = Window.partitionBy("name", "batch_size").orderBy("source", "trial")
    return trials.withColumn("trial", F.row_number().over(order) - 1)


def effective_batches(batches: Column, queries: int) -> Column:
    """Batch sizes cut to the number of queries, the first of equal ones kept."""
    return F.array_distinct(F.transform(batches, lambda b: F.least(b, F.lit(queries))))


def figure_rows(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(configuration, metric, mean, min, max): what a figure plots."""
    parts = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])
    return runs.select(*by, F.explode(parts).alias("p")).where("p.x is not null").groupBy(*by, "p.metric").agg(F.avg("p.x").alias("mean"), F.min("p.x").alias("low"), F.max("p.x").alias("high"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how many rows each combination has, nulls included."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def role_counts(rows: DataFrame, key: str, roles: list[str], role: str = "role") -> DataFrame:
    """By ``key`` one column for each of ``roles`` with the number of its rows, 0 where it has none."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(role) == r).alias(r) for r in roles])


def matrix_summary(rows: DataFrame, column: str = "vec") -> DataFrame:
    """One row: rows, the least and the largest number of values in a row, least and largest finite value, and how many
    values are null, NaN or infinite. Rows whose array is null count as rows only; an empty table has null extremes."""
    finite = F.filter(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    each = rows.select(F.size(column).alias("n"), F.size(finite).alias("good"), F.array_min(finite).alias("low"), F.array_max(finite).alias("high")).select(F.when(F.col("n") >= 0, F.col("n")).alias("n"), "good", "low", "high")
    return each.agg(F.count("*").alias("rows"), F.min("n").alias("least_features"), F.max("n").alias("features"), F.min("low").alias("minimum_value"), F.max("high").alias("maximum_value"), F.coalesce(F.sum(F.col("n") - F.col("good")), F.lit(0)).alias("not_finite"))


def table_payload(queries: Column, references: Column) -> Column:
    """Bytes of a full table of distances with two numbers a query beside it, eight bytes each."""
    return (queries.cast("bigint") * references + queries.cast("bigint") * 2) * 8


def epsilon_suffix(epsilon: float) -> str:
    """The number as the end of a column name: 0.05 is 0_05. The usual tenths keep two digits, as 0_10 and 0_20."""
    usual = {0.1: "0_10", 0.2: "0_20"}  # fixed values
    return usual.get(round(epsilon, 12), format(epsilon, ".12g").replace(".", "_").replace("-", "m"))


def flattened(quality: DataFrame, failures: str, epsilons: list[float]) -> DataFrame:
    """``quality`` with the structs' fields as columns (``struct_field``) and, in place of the array ``failures`` of
    (epsilon, rate), a column approximation_failure_rate_epsilon_... for each of ``epsilons``, null where it has none."""
    out: list[Column] = []
    for field in quality.schema.fields:
        if field.name == failures:
            rates = F.map_from_entries(F.transform(failures, lambda x: F.struct(F.round(x["epsilon"], 12).cast("string"), x["rate"])))
            out += [F.try_element_at(rates, F.round(F.lit(e), 12).cast("string")).alias(f"approximation_failure_rate_epsilon_{epsilon_suffix(e)}") for e in epsilons]
        elif hasattr(field.dataType, "fields"):
            out += [F.col(f"`{field.name}`").getField(f.name).alias(f"{field.name}_{f.name}") for f in field.dataType.fields]
        else:
            out.append(F.col(f"`{field.name}`"))
    return quality.select(*out)


def wide(aggregates: DataFrame) -> DataFrame:
    """Aggregates of :func:`across_seeds` as a CSV file can hold them: arrays are joined by semicolons."""
    arrays = {f.name for f in aggregates.schema.fields if hasattr(f.dataType, "elementType")}
    return aggregates.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if c in arrays else F.col(c) for c in aggregates.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; refuses to overwrite. Arrays are joined as in :func:`wide`."""
    wide(rows).write.option("header", True).csv(path)


# Which indexes a choice of lines shows.
LINES = {"flat-uniform": ["flat", "uniform"], "flat-hierarchical": ["flat", "hierarchical"], "both": ["flat", "hierarchical"], "all": ["flat", "uniform", "hierarchical"]}


def line_rows(aggregates: DataFrame, choice: str, repetitions: list[int] | None = None, projection_dimensions: list[int] | None = None, most: int | None = None) -> DataFrame:
    """The configurations that a line plot shows: those of ``choice`` (a name of ``LINES`` or an index) with the given
    repetitions and, for hierarchical ones, projections. Raises if there are none or, where ``most`` is given, more."""
    rows = aggregates.where(F.col("index").isin(LINES.get(choice, [choice])))
    if repetitions is not None:
        rows = rows.where(F.col("repetitions").isin(repetitions))
    if projection_dimensions is not None:
        rows = rows.where((F.col("index") != "hierarchical") | F.col("projection_dimension").isin(projection_dimensions))
    if most is not None:
        found = rows.limit(most + 1).count()
        if not 0 < found <= most:
            raise ValueError("the choice of lines finds none" if not found else f"the choice of lines finds more than {most}")
    return rows
