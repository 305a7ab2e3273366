"""The registered queries on ``embeddings`` (references: vec_id < 33, queries: the rest) with their DuckDB SQL.

Doubles that come out of transcendental functions or of sums in no fixed order are rounded on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.operators import datasets, index, metrics, sampling, scan
from nearfield.plans import setup, summary
from nearfield.sources import storage

N_REFS, T, SEED, P = 33, 16, 42, 16


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"), "label")


def refs(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).where(F.col("vec_id") < N_REFS).withColumnRenamed("vec_id", "ref_id")


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).where(F.col("vec_id") >= N_REFS).withColumnRenamed("vec_id", "query_id")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return queries_of(spark, sf), refs(spark, sf)


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _round_scaled(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """As DuckDB's round(): the number times a power of ten goes to the next integer, a half away from zero. F.round
    takes the decimal digits instead, which differs where the product falls on a half or off it."""

    def rounded(x):
        scaled = x * F.lit(10.0**digits)
        whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled)) / F.lit(10.0**digits)
        return F.when(F.isnan(whole) | (F.abs(whole) == F.lit(float("inf"))), x).otherwise(whole)

    return df.withColumns({n: rounded(F.col(n)) for n in names})


def _round_vec(df: DataFrame, digits: int, name: str = "vec") -> DataFrame:
    return df.withColumn(name, F.transform(name, lambda x: F.round(x, digits)))


def _probs(spark: SparkSession, sf: str, metric: str = "l2") -> DataFrame:
    """Importance probabilities to 12 digits, so that both engines draw from the same numbers."""
    return _round(sampling.importance_probabilities(refs(spark, sf), metric), 12, "prob")


def _sample(spark: SparkSession, sf: str, metric: str = "l2") -> DataFrame:
    return sampling.coordinate_sample(_probs(spark, sf, metric), T, SEED)


def _uniform(spark: SparkSession) -> DataFrame:
    return sampling.uniform_probabilities(spark, 16.0, 64)


# SQL building blocks.
_BASE = f"""refs AS (SELECT vec_id AS ref_id, embedding AS vec, label FROM embeddings WHERE vec_id < {N_REFS}),
queries AS (SELECT vec_id AS query_id, embedding AS vec, label FROM embeddings WHERE vec_id >= {N_REFS})"""


def _sum(expr: str, over: str) -> str:
    return f"coalesce(list_sum(list_transform(generate_series(1, len({over})), lambda i: {expr})), 0e0)"


def _d(metric: str, a: str = "q.vec", b: str = "r.vec") -> str:
    gap = f"({a}[i]::DOUBLE - {b}[i]::DOUBLE)"
    return _sum(f"abs{gap}" if metric == "l1" else f"{gap} * {gap}", a)


def _reported(metric: str, a: str = "q.vec", b: str = "r.vec") -> str:
    return _d(metric, a, b) if metric == "l1" else f"sqrt({_d(metric, a, b)})"


def _nearest(metric: str, q: str = "queries", r: str = "refs", d: str | None = None) -> str:
    return f"SELECT query_id, arg_min(ref_id, (d, ref_id)) AS ref_id, min(d) AS dist FROM (SELECT query_id, ref_id, {d or _d(metric)} AS d FROM {q} q, {r} r) GROUP BY query_id"


def _uniform_of(stream: str, *places: str) -> str:
    text = f"concat_ws('|', '{stream}', {SEED}, {', '.join(places)})"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT) / 4503599627370496e0)"


def _probs_sql(metric: str) -> str:
    gap = "abs(a.v::DOUBLE - b.v::DOUBLE)"
    part = gap if metric == "l1" else f"{gap} * {gap}"
    return f"""cells AS (SELECT ref_id, unnest(vec) AS v, (generate_subscripts(vec, 1) - 1)::INT AS j FROM refs),
whole AS (SELECT a.ref_id AS p, b.ref_id AS q, {_d(metric, "a.vec", "b.vec")} AS w FROM refs a JOIN refs b ON a.ref_id < b.ref_id),
shares AS (SELECT a.j, max(({part}) * (1e0 / w)) AS s FROM cells a JOIN cells b ON a.j = b.j AND a.ref_id < b.ref_id JOIN whole ON p = a.ref_id AND q = b.ref_id WHERE w > 0 GROUP BY a.j),
probs AS (SELECT DISTINCT c.j, round(least(1e0, coalesce(s, 0e0)), 12) AS prob FROM cells c LEFT JOIN shares USING (j))"""


_UNIFORM_SQL = "probs AS (SELECT j::INT AS j, 0.25e0 AS prob FROM range(64) t(j))"
_SAMPLE_SQL = f"""sample AS (SELECT j, len(list_filter(generate_series(1, {T}), lambda t: {_uniform_of("sample", "j", "t")} < prob))::BIGINT AS multiplicity, 1e0 / prob AS inv_prob FROM probs WHERE prob > 0),
drawn AS (SELECT * FROM sample WHERE multiplicity > 0),
row AS (SELECT list(j ORDER BY j) AS js, list(sqrt(multiplicity * inv_prob)::FLOAT ORDER BY j) AS scales, list(multiplicity * inv_prob ORDER BY j) AS weights FROM drawn)"""
_EMBED_SQL = """er AS (SELECT ref_id, list_transform(generate_series(1, len(js)), lambda i: vec[js[i] + 1] * scales[i]) AS vec, list_transform(js, lambda j: vec[j + 1]) AS plain FROM refs, row),
eq AS (SELECT query_id, list_transform(generate_series(1, len(js)), lambda i: vec[js[i] + 1] * scales[i]) AS vec, list_transform(js, lambda j: vec[j + 1]) AS plain, weights FROM queries, row)"""
_SIGNS_SQL = f"len(list_filter(generate_series(1, multiplicity), lambda t: {_uniform_of('sign', 'k', 'j', 't')} < 0.5e0))"
_JL_SQL = f"matrix AS (SELECT k::INT AS k, j, (2 * {_SIGNS_SQL} - multiplicity) * sqrt(inv_prob) * {1.0 / P**0.5!r}e0 AS coef FROM drawn, range({P}) t(k))"
_CAUCHY_SQL = f"matrix AS (SELECT k::INT AS k, j, tan(pi() * (({_uniform_of('cauchy', 'k', 'j')} * 4503599627370496e0 + 0.5e0) / 4503599627370496e0 - 0.5e0)) * inv_prob * multiplicity AS coef FROM drawn, range({P}) t(k))"
_PROJECT_SQL = """mrows AS (SELECT k, list(coef ORDER BY j) AS m FROM matrix GROUP BY k),
pr AS (SELECT ref_id, list(x ORDER BY k) AS vec FROM (SELECT ref_id, k, list_sum(list_transform(generate_series(1, len(js)), lambda i: m[i] * vec[js[i] + 1]::DOUBLE)) AS x FROM refs, row, mrows) GROUP BY ref_id),
pq AS (SELECT query_id, list(x ORDER BY k) AS vec FROM (SELECT query_id, k, list_sum(list_transform(generate_series(1, len(js)), lambda i: m[i] * vec[js[i] + 1]::DOUBLE)) AS x FROM queries, row, mrows) GROUP BY query_id)"""
_MEDIAN_SQL = """list_sort(list_transform(generate_series(1, len(q.vec)), lambda i: abs(q.vec[i] - r.vec[i])))[len(q.vec) // 2]
  + (list_sort(list_transform(generate_series(1, len(q.vec)), lambda i: abs(q.vec[i] - r.vec[i])))[len(q.vec) // 2 + 1]
   - list_sort(list_transform(generate_series(1, len(q.vec)), lambda i: abs(q.vec[i] - r.vec[i])))[len(q.vec) // 2]) * 0.5e0"""


def _table_sql(metric: str) -> str:
    return f"dt AS (SELECT query_id, ref_id, {_reported(metric)} AS dist FROM queries q, refs r)"


_MARGIN_SQL = "CASE WHEN optimum > 0 THEN second / optimum WHEN second = 0 THEN 1e0 ELSE 'inf'::DOUBLE END"
_BUCKET_SQL = "(CASE WHEN margin >= 1.25 THEN 4 WHEN margin >= 1.1 THEN 3 WHEN margin >= 1.05 THEN 2 WHEN margin >= 1.01 THEN 1 ELSE 0 END)::INT"
_OPTIMA_SQL = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rn, rank() OVER (PARTITION BY query_id ORDER BY dist) AS rk FROM dt),
o0 AS (SELECT query_id, min(dist) AS optimum, coalesce(max(dist) FILTER (WHERE rn = 2), 'inf'::DOUBLE) AS second, count(*) FILTER (WHERE rk = 1) AS multiplicity FROM rk GROUP BY query_id),
o1 AS (SELECT *, {_MARGIN_SQL} AS margin FROM o0),
optima AS (SELECT *, {_BUCKET_SQL} AS bucket FROM o1)"""


def _summary_sql(value: str, prefix: str = "", digits: int = 9) -> str:
    qs = ", ".join(f"quantile_disc({value}, {p}) AS {prefix}{n}" for p, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99")))
    return f"count({value}) AS {prefix}count, round(avg({value}), {digits}) AS {prefix}mean, {qs}, max({value}) AS {prefix}max"


# Predictions to be judged: the second nearest reference of every third query, the nearest of the others.
def _predictions(table: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "ref_id"))
    return table.withColumn("rn", rank).where(F.col("rn") == F.when(F.col("query_id") % 3 == 0, 2).otherwise(1)).select("query_id", "ref_id")


_PREDICTED_SQL = "predicted AS (SELECT query_id, ref_id FROM rk WHERE rn = CASE WHEN query_id % 3 = 0 THEN 2 ELSE 1 END)"
_JUDGED_SQL = """returned AS (SELECT p.query_id, p.ref_id, dist AS returned FROM predicted p JOIN dt USING (query_id, ref_id)),
nearer AS (SELECT query_id, count(*) FILTER (WHERE dist < returned) AS nearer FROM dt JOIN returned USING (query_id) GROUP BY query_id),
judged AS (SELECT r.query_id, r.ref_id, returned, optimum, nearer + 1 AS rank, CASE WHEN optimum > 0 THEN returned / optimum END AS ratio, returned = optimum AS optimal, margin, bucket
  FROM returned r JOIN optima USING (query_id) JOIN nearer USING (query_id))"""


def _judged(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    queries, r = _sides(spark, sf)
    return metrics.judged_of(_predictions(metrics.distance_table(queries, r, metric)), queries, r, metric)


def _judged_by_table(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.distance_table(*_sides(spark, sf), "l2")
    return metrics.judged(_predictions(table), table)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((_BASE, *parts)) + "\n"


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    _ALL[name] = query, sql


for _m in ("l1", "l2"):
    _add(f"exact_{_m}", lambda s, f, m=_m: index.exact(m).fit(refs(s, f)).transform(queries_of(s, f)), _with() + _nearest(_m))
    _add(f"distance_table_{_m}", lambda s, f, m=_m: metrics.distance_table(*_sides(s, f), m), _with() + f"SELECT query_id, ref_id, {_reported(_m)} AS dist FROM queries q, refs r")
    _add(
        f"query_geometry_{_m}",
        lambda s, f, m=_m: _round(metrics.geometry(metrics.optima_of(*_sides(s, f), m)), 9, "margin_mean"),
        _with(_table_sql(_m), _OPTIMA_SQL) + f"SELECT count(*) AS queries, count(*) FILTER (WHERE optimum = 0) AS zero_optimum, count(*) FILTER (WHERE multiplicity > 1) AS non_unique, count(*) FILTER (WHERE margin = 'inf') AS infinite_margins, {_summary_sql('fin', 'margin_')} FROM (SELECT *, CASE WHEN margin < 'inf' THEN margin END AS fin FROM optima)",
    )
    _add(f"importance_probs_{_m}", lambda s, f, m=_m: _probs(s, f, m), _with(_probs_sql(_m)) + "SELECT j, prob FROM probs")
    _add(
        f"flat_{_m}",
        lambda s, f, m=_m: _round(index.flat(m, T, SEED).fit(refs(s, f), _probs(s, f, m)).transform(queries_of(s, f)), 6, "dist"),
        _with(_probs_sql(_m), _SAMPLE_SQL, _EMBED_SQL) + (f"SELECT query_id, ref_id, round(dist, 6) AS dist FROM ({_nearest('l2', 'eq', 'er')})" if _m == "l2" else f"SELECT query_id, ref_id, round(dist, 6) AS dist FROM ({_nearest('l1', 'eq', 'er', _sum('abs(q.plain[i]::DOUBLE - r.plain[i]::DOUBLE) * q.weights[i]', 'q.plain'))})"),
    )
    _add(
        f"uniform_{_m}",
        lambda s, f, m=_m: _round(index.uniform(m, T, SEED).fit(refs(s, f), mass=16.0).transform(queries_of(s, f)), 6, "dist"),
        _with(_UNIFORM_SQL, _SAMPLE_SQL, _EMBED_SQL) + (f"SELECT query_id, ref_id, round(dist, 6) AS dist FROM ({_nearest('l2', 'eq', 'er')})" if _m == "l2" else f"SELECT query_id, ref_id, round(dist, 6) AS dist FROM ({_nearest('l1', 'eq', 'er', _sum('abs(q.plain[i]::DOUBLE - r.plain[i]::DOUBLE) * q.weights[i]', 'q.plain'))})"),
    )
    _add(
        f"hierarchical_{_m}",
        lambda s, f, m=_m: _round(index.hierarchical(m, T, P, SEED).fit(refs(s, f), _probs(s, f, m)).transform(queries_of(s, f)), 6, "dist"),
        _with(_probs_sql(_m), _SAMPLE_SQL, _JL_SQL if _m == "l2" else _CAUCHY_SQL, _PROJECT_SQL) + f"SELECT query_id, ref_id, round(dist, 6) AS dist FROM ({_nearest(_m, 'pq', 'pr', _MEDIAN_SQL if _m == 'l1' else None)})",
    )
for _s in ("relational", "parallel_references", "direct"):
    _add(f"exact_l2_{_s}", lambda s, f, k=_s: _round(scan.nearest(*_sides(s, f), "l2", k), 9, "dist"), _with() + f"SELECT query_id, ref_id, round(dist, 9) AS dist FROM ({_nearest('l2')})")
for _m, _s in (("l1", "array_scan"), ("l1", "parallel_references"), ("l2", "array_scan")):
    for _kind in ("flat", "hierarchical"):
        _add(f"{_kind}_{_m}_{_s}", lambda s, f, m=_m, k=_s, n=_kind: _round((index.flat(m, T, SEED, k) if n == "flat" else index.hierarchical(m, T, P, SEED, k)).fit(refs(s, f), _probs(s, f, m)).transform(queries_of(s, f)), 6, "dist"), _ALL[f"{_kind}_{_m}"][1])
_add("exact_l2_array_scan", lambda s, f: index.exact("l2", "array_scan").fit(refs(s, f)).transform(queries_of(s, f)), _ALL["exact_l2"][1])
_add("hierarchical_l2_gemm", lambda s, f: index.hierarchical("l2", T, P, SEED, "gemm").fit(refs(s, f), _probs(s, f)).transform(queries_of(s, f)).select("query_id", "ref_id"), "SELECT query_id, ref_id FROM (" + _ALL["hierarchical_l2"][1] + ")")
_add("exact_l2_gemm", lambda s, f: scan.nearest(*_sides(s, f), "l2", "gemm").select("query_id", "ref_id"), _with() + f"SELECT query_id, ref_id FROM ({_nearest('l2')})")
_add("exact_l1_direct", lambda s, f: _round(scan.nearest(*_sides(s, f), "l1", "direct"), 9, "dist"), _with() + f"SELECT query_id, ref_id, round(dist, 9) AS dist FROM ({_nearest('l1')})")
_add("margin_buckets", lambda s, f: metrics.buckets(metrics.optima_of(*_sides(s, f))), _with(_table_sql("l2"), _OPTIMA_SQL) + "SELECT b::INT AS bucket, count(query_id) AS queries FROM range(5) t(b) LEFT JOIN optima ON bucket = b GROUP BY b")
_add("optima_l2", lambda s, f: metrics.optima(metrics.distance_table(*_sides(s, f))), _with(_table_sql("l2"), _OPTIMA_SQL) + "SELECT query_id, optimum, second, multiplicity, margin, bucket FROM optima")
_add("returned_rank", lambda s, f: _judged_by_table(s, f), _with(_table_sql("l2"), _OPTIMA_SQL, _PREDICTED_SQL, _JUDGED_SQL) + "SELECT query_id, ref_id, returned, optimum, rank, ratio, optimal, margin, bucket FROM judged")
_EVALUATE_SQL = f"""SELECT count(*) AS queries, count(*) FILTER (WHERE optimal) AS optimal, count(*) FILTER (WHERE NOT optimal) AS non_optimal, count(*) FILTER (WHERE optimum = 0 AND NOT optimal) AS zero_optimum_misses,
{_summary_sql("ratio", "ratio_")}, round(avg(ratio) FILTER (WHERE NOT optimal), 9) AS non_optimal_ratio_mean"""
_add(
    "evaluate_l2",
    lambda s, f: _round(metrics.evaluate(_judged(s, f, "l2")), 9, "ratio_mean", "non_optimal_ratio_mean", "rank_mean"),
    _with(_table_sql("l2"), _OPTIMA_SQL, _PREDICTED_SQL, _JUDGED_SQL) + _EVALUATE_SQL + ", round(avg(rank), 9) AS rank_mean, quantile_disc(rank, 0.95)::DOUBLE AS rank_p95 FROM judged",
)
_add(
    "epsilon_failures",
    lambda s, f: metrics.epsilon_failures(_judged(s, f, "l2")),
    _with(_table_sql("l2"), _OPTIMA_SQL, _PREDICTED_SQL, _JUDGED_SQL) + "SELECT e::DOUBLE AS epsilon, count(*) FILTER (WHERE CASE WHEN optimum = 0 THEN NOT optimal ELSE ratio > 1 + e::DOUBLE END) AS violations, count(*) FILTER (WHERE CASE WHEN optimum = 0 THEN NOT optimal ELSE ratio > 1 + e::DOUBLE END) / count(*)::DOUBLE AS rate FROM judged, (SELECT unnest([0.001, 0.005, 0.01, 0.02, 0.05, 0.1]) AS e) GROUP BY e",
)
_add(
    "bucket_quality",
    lambda s, f: _round(metrics.bucket_quality(_judged(s, f, "l2")), 9, "ratio_mean"),
    _with(_table_sql("l2"), _OPTIMA_SQL, _PREDICTED_SQL, _JUDGED_SQL) + "SELECT b::INT AS bucket, count(query_id) AS queries, count(*) FILTER (WHERE NOT optimal) AS errors, round(avg(ratio), 9) AS ratio_mean FROM range(5) t(b) LEFT JOIN judged ON bucket = b GROUP BY b",
)


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    queries, r = _sides(spark, sf)
    table = metrics.distance_table(queries, r)
    exact = index.exact().fit(r).transform(queries)
    return metrics.judged_selected(_predictions(table), exact, queries, r)


_add(
    "selected_distances",
    lambda s, f: _round(metrics.evaluate(_selected(s, f)), 9, "ratio_mean", "non_optimal_ratio_mean"),
    _with(_table_sql("l2"), _OPTIMA_SQL, _PREDICTED_SQL, _JUDGED_SQL) + _EVALUATE_SQL.replace("SELECT", "SELECT count(*) FILTER (WHERE returned < optimum) AS improvements,", 1) + " FROM (SELECT * REPLACE (returned <= optimum AS optimal) FROM judged)",
)
_add("distribution_summary", lambda s, f: _round(metrics.summary(metrics.distance_table(*_sides(s, f)), "dist"), 9, "mean"), _with(_table_sql("l2")) + f"SELECT {_summary_sql('dist')} FROM dt")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    queries, r = _sides(spark, sf)
    return metrics.basic_quality(index.flat("l2", T, SEED).fit(r, _probs(spark, sf)).transform(queries), index.exact().fit(r).transform(queries), queries, r)


_add(
    "basic_quality",
    _quality,
    _with(_probs_sql("l2"), _SAMPLE_SQL, _EMBED_SQL, f"got AS ({_nearest('l2', 'eq', 'er')})", f"ex AS ({_nearest('l2')})")
    + "SELECT count(*) AS queries, count(*) FILTER (WHERE g.ref_id = e.ref_id) AS agreeing, count(*) FILTER (WHERE a.label = q.label) AS label_correct, count(*) FILTER (WHERE a.label = b.label) AS label_agreeing FROM got g JOIN ex e USING (query_id) JOIN queries q USING (query_id) JOIN refs a ON a.ref_id = g.ref_id JOIN refs b ON b.ref_id = e.ref_id",
)
_add("sampling_mass", lambda s, f: _round(sampling.sampling_mass(_probs(s, f)), 6, "mass"), _with(_probs_sql("l2")) + "SELECT round(sum(prob), 6) AS mass FROM probs")
_add("uniform_probs", lambda s, f: _uniform(s), "SELECT j::INT AS j, 0.25e0 AS prob FROM range(64) t(j)")
_add("importance_probs_blocked", lambda s, f: _round(sampling.importance_probabilities(refs(s, f), "l2", "blocked"), 9, "prob"), _with(_probs_sql("l2")) + "SELECT j, round(prob, 9) AS prob FROM probs")
_add("importance_probs_relational", lambda s, f: _round(sampling.importance_probabilities(refs(s, f), "l2", "relational"), 9, "prob"), _with(_probs_sql("l2")) + "SELECT j, round(prob, 9) AS prob FROM probs")
_add("importance_probs_gram", lambda s, f: _round(sampling.importance_probabilities(refs(s, f), "l2", "gram"), 9, "prob"), _with(_probs_sql("l2")) + "SELECT j, round(prob, 9) AS prob FROM probs")
_add("coordinate_sample_importance", lambda s, f: _sample(s, f), _with(_probs_sql("l2"), _SAMPLE_SQL) + "SELECT j, multiplicity, inv_prob FROM drawn")
_add("coordinate_sample_uniform", lambda s, f: sampling.coordinate_sample(_uniform(s), T, SEED), _with(_UNIFORM_SQL, _SAMPLE_SQL) + "SELECT j, multiplicity, inv_prob FROM drawn")
_add("l2_embedding_refs", lambda s, f: sampling.embedded(refs(s, f), _sample(s, f), "l2").select("ref_id", F.explode("vec").alias("v")).select("ref_id", F.col("v").cast("double").alias("v")), _with(_probs_sql("l2"), _SAMPLE_SQL, _EMBED_SQL) + "SELECT ref_id, unnest(vec)::DOUBLE AS v FROM er")
_add("packed_queries", lambda s, f: sampling.embedded(queries_of(s, f), _sample(s, f), "l2").select("query_id", F.posexplode("vec").alias("place", "v")).select("query_id", "place", F.col("v").cast("double").alias("v")), _with(_probs_sql("l2"), _SAMPLE_SQL, _EMBED_SQL) + "SELECT query_id, (generate_subscripts(vec, 1) - 1)::INT AS place, unnest(vec)::DOUBLE AS v FROM eq")
_add("jl_matrix", lambda s, f: _round(sampling.projection(_sample(s, f), "l2", P, SEED), 9, "coef"), _with(_probs_sql("l2"), _SAMPLE_SQL, _JL_SQL) + "SELECT k, j, round(coef, 9) AS coef FROM matrix")
_add("cauchy_matrix", lambda s, f: _round(sampling.projection(_sample(s, f, "l1"), "l1", P, SEED), 6, "coef"), _with(_probs_sql("l1"), _SAMPLE_SQL, _CAUCHY_SQL) + "SELECT k, j, round(coef, 6) AS coef FROM matrix")
_add(
    "project_refs",
    lambda s, f: _round(sampling.projected(refs(s, f), _sample(s, f), sampling.projection(_sample(s, f), "l2", P, SEED)).select("ref_id", F.posexplode("vec").alias("k", "v")), 9, "v"),
    _with(_probs_sql("l2"), _SAMPLE_SQL, _JL_SQL, _PROJECT_SQL) + "SELECT ref_id, (generate_subscripts(vec, 1) - 1)::INT AS k, round(unnest(vec), 9) AS v FROM pr",
)


def _spaces(spark: SparkSession, sf: str) -> DataFrame:
    r, out = refs(spark, sf), None
    for metric in ("l1", "l2"):
        sample = _sample(spark, sf, metric)
        for built in (index.exact(metric).fit(r), index.flat(metric, T, SEED).fit(r, sample=sample), index.hierarchical(metric, T, P, SEED).fit(r, sample=sample)):
            row = built.space_usage().select(F.lit(metric).alias("metric"), F.lit(built.settings.family).alias("family"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def _space_sql(metric: str) -> str:
    work, double = ("0", 2) if metric == "l1" else ("i * 4", 1)
    flat = "i * 24 + r * i * 4" if metric == "l1" else "r * i * 4 + i * 12"
    n = f"(SELECT count(*) AS i, sum(multiplicity) AS m FROM drawn_{metric}), (SELECT count(*) AS r FROM refs)"
    return f"""SELECT '{metric}' AS metric, 'exact' AS family, r * 256 AS index_bytes, 0 AS workspace_bytes, 64 AS unique_coordinates, 64 AS total_multiplicity FROM {n}
UNION ALL SELECT '{metric}', 'flat', {flat}, {work}, i, m FROM {n}
UNION ALL SELECT '{metric}', 'hierarchical', i * 24 + i * 8 * {P} + r * 8 * {P}, i * 4 + {P} * 8 * {double}, i, m FROM {n}"""


def _renamed(sql: str, metric: str) -> str:
    """The sampling steps under names of their own, so that both metrics fit in one statement."""
    return re.sub(r"\b(cells|whole|shares|probs|sample|drawn|row)(?= AS \(|$| WHERE|\)| c\b| a\b| b\b| ON\b| USING\b)", rf"\1_{metric}", sql)


_add(
    "space_usage",
    _spaces,
    _with(*[_renamed(x, m) for m in ("l1", "l2") for x in (_probs_sql(m), _SAMPLE_SQL)]) + "SELECT metric, family, index_bytes::BIGINT AS index_bytes, workspace_bytes::BIGINT AS workspace_bytes, unique_coordinates::BIGINT AS unique_coordinates, total_multiplicity::BIGINT AS total_multiplicity FROM (" + _space_sql("l1") + "\nUNION ALL " + _space_sql("l2") + ")",
)

# Dataset preparation.
_CELLS = "c AS (SELECT vec_id, label, unnest(embedding) AS v, (generate_subscripts(embedding, 1) - 1)::INT AS j FROM embeddings)"
_SPLIT = """s0 AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 42, vec_id)), vec_id) AS k FROM embeddings),
s AS (SELECT vec_id, label, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.7e0, 0))) THEN 'pool' ELSE 'query' END AS role FROM s0)"""
_add("class_centroids", lambda s, f: datasets.class_centroids(embeddings(s, f)).select("label", F.posexplode("vec").alias("j", "v")).select("label", "j", F.round(F.col("v").cast("double"), 5).alias("v")), f"WITH {_CELLS} SELECT label, j, round(avg(v::DOUBLE)::FLOAT::DOUBLE, 5) AS v FROM c GROUP BY label, j")


def _centroid_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    centers = datasets.class_centroids(rows).select(F.col("label").cast("bigint").alias("ref_id"), "vec")
    found = scan.nearest(rows.withColumnRenamed("vec_id", "query_id"), centers, "l2").join(rows.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return found.groupBy("label").agg(F.count("*").alias("queries"), F.count_if(F.col("ref_id") == F.col("label")).alias("correct"))


_add(
    "nearest_centroid_accuracy",
    _centroid_accuracy,
    f"WITH {_CELLS}, refs AS (SELECT label AS ref_id, list(v ORDER BY j) AS vec FROM (SELECT label, j, avg(v::DOUBLE)::FLOAT AS v FROM c GROUP BY label, j) GROUP BY label), queries AS (SELECT vec_id AS query_id, embedding AS vec, label FROM embeddings), f AS ({_nearest('l2')}) SELECT label, count(*) AS queries, count(*) FILTER (WHERE ref_id = label) AS correct FROM f JOIN queries USING (query_id) GROUP BY label",
)
_add("stratified_split", lambda s, f: datasets.stratified_split(embeddings(s, f), 0.7, 42).select("vec_id", "label", "role"), f"WITH {_SPLIT} SELECT vec_id, label, role FROM s")
_add("role_row_index", lambda s, f: datasets.role_index(datasets.stratified_split(embeddings(s, f), 0.7, 42), order="vec_id").select("vec_id", "role", "role_row_index"), f"WITH {_SPLIT} SELECT vec_id, role, (row_number() OVER (PARTITION BY role ORDER BY vec_id) - 1)::INT AS role_row_index FROM s")


def _zscore(spark: SparkSession, sf: str) -> DataFrame:
    rows = datasets.stratified_split(embeddings(spark, sf), 0.7, 42)
    scaled = datasets.normalise(rows, datasets.fit_normaliser(rows.where("role = 'pool'")))
    return scaled.select("vec_id", F.posexplode("vec").alias("j", "v")).select("vec_id", "j", (F.round(F.col("v").cast("double"), 3) + 0.0).alias("v"))


_add("zscore_from_pool", _zscore, f"WITH {_CELLS}, {_SPLIT}, n AS (SELECT j, avg(v::DOUBLE)::FLOAT AS m, (CASE WHEN stddev_pop(v::DOUBLE) = 0 THEN 1 ELSE stddev_pop(v::DOUBLE) END)::FLOAT AS sc FROM c JOIN s USING (vec_id) WHERE role = 'pool' GROUP BY j) SELECT vec_id, j, round(((v - m) / sc)::DOUBLE, 3) + 0e0 AS v FROM c JOIN n USING (j)")
_add("top_variance", lambda s, f: _round(datasets.top_variance(embeddings(s, f), 8), 9, "variance"), f"WITH {_CELLS}, v AS (SELECT label, j, var_pop(v::DOUBLE) AS x FROM c GROUP BY label, j) SELECT label, rank, j, round(x, 9) AS variance FROM (SELECT label, j, x, (row_number() OVER (PARTITION BY label ORDER BY round(x, 12) DESC, j))::INT AS rank FROM v) WHERE rank <= 8")
_add("nearest_rivals", lambda s, f: datasets.nearest_rivals(refs(s, f)), _with() + f"SELECT ref_id, arg_min(rival_id, (d, rival_id)) AS rival_id, min(d) AS dist_sq FROM (SELECT a.ref_id, b.ref_id AS rival_id, {_d('l2', 'a.vec', 'b.vec')} AS d FROM refs a JOIN refs b ON a.ref_id != b.ref_id) GROUP BY ref_id")
_add(
    "lloyd_step",
    lambda s, f: datasets.lloyd_step(embeddings(s, f), embeddings(s, f).where("vec_id < 8").withColumnRenamed("vec_id", "center_id")).select("center_id", "size", F.posexplode("vec").alias("j", "v")).select("center_id", "size", "j", F.round("v", 9).alias("v")),
    f"WITH {_CELLS}, refs AS (SELECT vec_id AS ref_id, embedding AS vec FROM embeddings WHERE vec_id < 8), queries AS (SELECT vec_id AS query_id, embedding AS vec FROM embeddings), f AS ({_nearest('l2')}) SELECT ref_id AS center_id, count(*) AS size, j, round(avg(v::DOUBLE), 9) AS v FROM c JOIN f ON query_id = vec_id GROUP BY ref_id, j",
)
_add(
    "transpose_long_to_array",
    lambda s, f: datasets.transpose(embeddings(s, f).select("vec_id", F.posexplode("vec").alias("j", "v")), "j", "vec_id", "v").select("vec_id", F.size("vec").alias("n"), F.round(vectors.squared_norm(F.col("vec")), 9).alias("norm")),
    "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 9) AS norm FROM embeddings",
)
_add("label_anti_join", lambda s, f: datasets.missing_labels(queries_of(s, f), refs(s, f).where("label < 7")), _with() + "SELECT DISTINCT label FROM queries WHERE label NOT IN (SELECT label FROM refs WHERE label < 7)")
_add("log2_plus_one", lambda s, f: refs(s, f).select("ref_id", F.posexplode(datasets.log2_plus_one(F.transform("vec", lambda x: F.abs(x)))).alias("j", "v")).select("ref_id", "j", F.round("v", 9).alias("v")), _with() + "SELECT ref_id, (generate_subscripts(vec, 1) - 1)::INT AS j, round(log2(abs(unnest(vec))::DOUBLE + 1), 9) AS v FROM refs")
_add("pair_distances", lambda s, f: refs(s, f).alias("a").join(refs(s, f).alias("b"), F.col("a.ref_id") < F.col("b.ref_id")).select(F.col("a.ref_id").alias("p"), F.col("b.ref_id").alias("q"), vectors.l1_distance(F.col("a.vec"), F.col("b.vec")).alias("l1"), F.round(vectors.dot(F.col("a.vec"), F.col("b.vec")), 9).alias("dot"), vectors.median_abs_difference(F.col("a.vec"), F.col("b.vec")).alias("median")), _with() + f"SELECT a.ref_id AS p, b.ref_id AS q, {_d('l1', 'a.vec', 'b.vec')} AS l1, round({_sum('a.vec[i]::DOUBLE * b.vec[i]::DOUBLE', 'a.vec')}, 9) AS dot, median(g) AS median FROM (SELECT a, b, unnest(list_transform(generate_series(1, len(a.vec)), lambda i: abs(a.vec[i]::DOUBLE - b.vec[i]::DOUBLE))) AS g FROM refs a JOIN refs b ON a.ref_id < b.ref_id) GROUP BY a, b")
_add("inventory_difference", lambda s, f: datasets.inventory(queries_of(s, f).select("label"), refs(s, f).select("label")).groupBy("problem", "label").agg(F.count("*").alias("n")), _with() + "SELECT 'missing' AS problem, label, count(*) AS n FROM (SELECT label FROM refs EXCEPT ALL SELECT label FROM queries) GROUP BY label UNION ALL SELECT 'extra', label, count(*) FROM (SELECT label FROM queries EXCEPT ALL SELECT label FROM refs) GROUP BY label")
_add("key_alignment", lambda s, f: datasets.aligned(queries_of(s, f), refs(s, f), "label"), _with() + "SELECT coalesce(a.label, b.label) AS label, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM (SELECT label, count(*) AS l FROM queries GROUP BY label) a FULL JOIN (SELECT label, count(*) AS r FROM refs GROUP BY label) b ON a.label = b.label WHERE coalesce(l, 0) != 1 OR coalesce(r, 0) != 1")
_add("page_links", lambda s, f: s.read.parquet(f"{f}/pages.parquet").select("page_id", F.size(storage.links(F.col("html"), "^/")).cast("bigint").alias("n")), """SELECT page_id, coalesce(len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: starts_with(x, '/'))), 0)::BIGINT AS n FROM pages""")

# Reports. Runs are made of the supplier table's numbers, so that both engines read the same rows.
_RUNS = """SELECT 'run' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'flat' ELSE 'hierarchical' END AS index, s_nationkey AS seed, (s_suppkey % 5 + 1) * 8 AS repetitions,
  (s_suppkey % 3) * 32 AS projection_dimension, 'cpu' AS backend, 'sequential' AS strategy, 1 AS batch_size, abs(CAST(s_acctbal AS DOUBLE)) + 1 AS us_per_query, (s_suppkey * 37 % 101) / 101e0 AS agreement,
  s_suppkey * 64 AS index_bytes, (s_suppkey % 5 + 1) * 3 AS unique_coordinates, (s_suppkey % 5 + 1) * 9 AS total_multiplicity FROM supplier"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("supplier")
    return spark.sql(_RUNS.replace("index,", "`index`,"))


_STATS_SQL = ", ".join(f"round(avg({v}), 9) AS {v}_mean, round(CASE WHEN count({v}) = 1 THEN 0 ELSE stddev_samp({v}) END, 6) AS {v}_stddev, min({v})::DOUBLE AS {v}_min, max({v})::DOUBLE AS {v}_max" for v in ("us_per_query", "agreement"))
_add(
    "aggregate_seeds",
    lambda s, f: (lambda d: d.select("index", "repetitions", "runs", F.array_join("seeds", ",").alias("seeds"), *[(F.round(c, 6 if c.endswith("stddev") else 9) if c.endswith(("mean", "stddev")) else F.col(c).cast("double")).alias(c) for c in d.columns if c.startswith(("us_", "agr"))]))(summary.across_seeds(_runs(s, f), ["index", "repetitions"], ("us_per_query", "agreement"))),
    f"SELECT index, repetitions, count(*) AS runs, array_to_string(list_sort(list_distinct(list(seed))), ',') AS seeds, {_STATS_SQL} FROM ({_RUNS}) GROUP BY index, repetitions",
)
_add(
    "flat_vs_hier",
    lambda s, f: _round_scaled(summary.hierarchical_against_flat(_runs(s, f)).select("name", "repetitions", "seed", "delta_us", "delta_agreement", "size_ratio"), 6, "delta_us", "delta_agreement", "size_ratio"),
    f"WITH r AS ({_RUNS}) SELECT h.name, h.repetitions, h.seed, round(h.us_per_query - g.us_per_query, 6) AS delta_us, round(h.agreement - g.agreement, 6) AS delta_agreement, round(h.index_bytes / g.index_bytes::DOUBLE, 6) AS size_ratio FROM r h JOIN r g USING (repetitions, seed, backend, strategy, batch_size) WHERE h.index = 'hierarchical' AND g.index = 'flat'",
)
for _name, _value, _up in (("pareto_agreement", "agreement", True), ("pareto_excess", "index_bytes", False)):
    _op, _agg, _dir = (">", "max", "DESC") if _up else ("<", "min", "ASC")
    _add(
        _name,
        lambda s, f, v=_value, u=_up: summary.pareto(_runs(s, f), "us_per_query", v, u).select("name", "us_per_query", v),
        f"SELECT name, us_per_query, {_value} FROM (SELECT *, {_agg}({_value}) OVER (ORDER BY us_per_query, {_value} {_dir} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({_RUNS})) WHERE seen IS NULL OR {_value} {_op} seen",
    )


def _unions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).where("repetitions = 8").select(F.when(F.col("seed") < 12, "exact").otherwise(F.col("name")).alias("name"), (F.col("seed") < 12).alias("reference"), "batch_size", F.array("us_per_query").alias("trial_ms"))
    out = summary.joined([rows.where("reference"), rows.where("not reference")])
    return out.select("name", "reference", "batch_size", F.size("trial_ms").alias("trials"), F.round("median_ms", 9).alias("median_ms"))


_add("union_runs", _unions, f"SELECT name, reference, batch_size, count(*)::INT AS trials, round(median(us_per_query), 9) AS median_ms FROM (SELECT CASE WHEN seed < 12 THEN 'exact' ELSE name END AS name, seed < 12 AS reference, batch_size, us_per_query FROM ({_RUNS}) WHERE repetitions = 8) GROUP BY ALL")
_add("figure_rows", lambda s, f: _round(summary.figure_rows(_runs(s, f), ["index", "repetitions"], ["us_per_query", "agreement"]), 9, "mean", "low", "high"), f"SELECT index, repetitions, metric, round(avg(x), 9) AS mean, round(min(x), 9) AS low, round(max(x), 9) AS high FROM (SELECT index, repetitions, unnest(['us_per_query', 'agreement']) AS metric, unnest([us_per_query, agreement]) AS x FROM ({_RUNS})) GROUP BY ALL")
_add("label_counts", lambda s, f: summary.counts_by(s.read.parquet(f"{f}/documents.parquet"), "lang", "source"), "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
_add("role_counts", lambda s, f: summary.role_counts(datasets.stratified_split(embeddings(s, f), 0.7, 42), "label", ["pool", "query"]), f"WITH {_SPLIT} SELECT label, count(*) FILTER (WHERE role = 'pool') AS pool, count(*) FILTER (WHERE role = 'query') AS query FROM s GROUP BY label")
_add(
    "matrix_summary",
    lambda s, f: summary.matrix_summary(embeddings(s, f)).select("rows", "least_features", "features", F.col("minimum_value").cast("double").alias("low"), F.col("maximum_value").cast("double").alias("high"), "not_finite"),
    "SELECT count(*) AS rows, min(len(embedding))::INT AS least_features, max(len(embedding))::INT AS features, min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high, sum(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))))::BIGINT AS not_finite FROM embeddings",
)
_add("table_payload", lambda s, f: embeddings(s, f).groupBy("label").agg(F.count("*").alias("queries")).select("label", summary.table_payload(F.col("queries"), F.lit(33)).alias("bytes")), "SELECT label, (8 * (count(*) * 33 + 2 * count(*)))::BIGINT AS bytes FROM embeddings GROUP BY label")
_add("line_rows", lambda s, f: summary.line_rows(_runs(s, f), "flat-hierarchical", [8, 24, 40], [32, 64]).select("name", "index", "repetitions", "projection_dimension"), f"SELECT name, index, repetitions, projection_dimension FROM ({_RUNS}) WHERE index IN ('flat', 'hierarchical') AND repetitions IN (8, 24, 40) AND (index != 'hierarchical' OR projection_dimension IN (32, 64))")
_add(
    "wide_aggregates",
    lambda s, f: summary.wide(summary.across_seeds(_runs(s, f), ["index", "repetitions"], ("index_bytes",))).select("index", "repetitions", "runs", "seeds", F.round("index_bytes_mean", 6).alias("index_bytes_mean"), "index_bytes_max"),
    f"SELECT index, repetitions, count(*) AS runs, array_to_string(list_sort(list_distinct(list(seed))), ';') AS seeds, round(avg(index_bytes), 6) AS index_bytes_mean, max(index_bytes) AS index_bytes_max FROM ({_RUNS}) GROUP BY index, repetitions",
)
_add("sub_centroids", lambda s, f: datasets.sub_centroids(embeddings(s, f), 4, 32).select("label", "cluster", "size"), None)
_add("synthetic_dataset", lambda s, f: (lambda rq: index.exact(strategy="direct").fit(rq[0]).transform(rq[1]))(datasets.synthetic(s, 16, 64, 512, 64)).select("query_id", "ref_id"), "SELECT q AS query_id, q % 16 AS ref_id FROM range(64) t(q)")

_SETUP = "\n".join(
    [
        "benchmark_setup_v2",
        "dataset\tdata",
        "json_output\tout.json",
        "csv_output\tout.csv",
        "reference\texact",
        "batch_sizes\t1,128",
        "run\texact\texact",
        "run\tflat8\tflat\trepetitions=8\tseed=42",
        "run\thier8\thierarchical\trepetitions=8\tseed=42\tprojection_dimension=16",
    ]
)
_add(
    "setup_runs",
    lambda s, f: setup.parse(_SETUP).frame(s).select("name", "index", "strategy", F.array_join("batch_sizes", ",").alias("batch_sizes"), "repetitions", "seed", "projection_dimension"),
    "SELECT * FROM (VALUES ('exact', 'exact', 'sequential', '1,128', NULL::INT, NULL::BIGINT, NULL::INT), ('flat8', 'flat', 'sequential', '1,128', 8, 42, NULL), ('hier8', 'hierarchical', 'sequential', '1,128', 8, 42, 16)) t(name, index, strategy, batch_sizes, repetitions, seed, projection_dimension)",
)

QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: exact L2 search."""
    return QUERIES["exact_l2"](spark, sf)
