"""Search, sampling and metrics on hand-computed values, and strategies against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors
from nearfield.operators import index, metrics, sampling, scan
from nearfield.streaming.scoring import score


def refs(spark, *rows):
    return spark.createDataFrame([(k, [float(x) for x in v], k) for k, v in enumerate(rows)], "ref_id bigint, vec array<float>, label int")


def queries(spark, *rows):
    return spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(rows)], "query_id bigint, vec array<float>, label int")


def sample(spark, *rows):
    return spark.createDataFrame(list(rows), "j int, multiplicity bigint, inv_prob double")


def probs(spark, *values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "j int, prob double")


def picks(df):
    return [r.ref_id for r in df.orderBy("query_id").collect()]


NAN = float("nan")


@pytest.mark.parametrize("strategy", ["automatic", "array_scan", "relational", "parallel_references", "direct", "gemm"])
def test_exact_ties_go_to_the_lowest(spark, strategy):
    r = refs(spark, (0, 0), (5, 0), (2, 4))
    assert picks(scan.nearest(queries(spark, (1, 0), (3, 3), (2.5, 0)), r, "l2", strategy)) == [0, 2, 0]
    if strategy != "gemm":
        assert picks(scan.nearest(queries(spark, (1, 0), (2, 3), (2.5, 0)), r, "l1", strategy)) == [0, 2, 0]


def test_exact_errors(spark):
    r = refs(spark, (0, 0), (5, 0), (2, 4))
    for bad in ((1, 0, 0), (NAN, 0)):
        with pytest.raises(Exception, match="differ|finite"):
            index.exact("l2").fit(r).transform(queries(spark, bad)).collect()
    with pytest.raises(Exception, match="finite"):
        index.exact("l1").fit(refs(spark, (NAN, 0))).transform(queries(spark, (1, 1))).collect()
    with pytest.raises(ValueError, match="no references"):
        index.exact().fit(r.limit(0))
    with pytest.raises(ValueError, match="matrix product"):
        scan.nearest(queries(spark, (1, 0)), r, "l1", "gemm")


def test_space(spark):
    r = refs(spark, (0, 0), (5, 0), (2, 4))
    assert tuple(index.exact().fit(r).space_usage().first()) == (24, 0, 2, 2)
    two, one = refs(spark, (0, 0), (5, 0)), sample(spark, (0, 16, 1.0))
    assert tuple(index.flat("l1", 16, 1).fit(two, sample=one).space_usage().first()) == (24 + 8, 0, 1, 16)
    assert tuple(index.hierarchical("l1", 16, 5, 1).fit(two, sample=one).space_usage().first()) == (24 + 40 + 80, 4 + 80, 1, 16)
    assert tuple(index.hierarchical("l2", 16, 5, 1).fit(two, sample=one).space_usage().first()) == (24 + 40 + 80, 4 + 40, 1, 16)


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_flat_and_hierarchical_see_one_coordinate(spark, metric):
    r, q = refs(spark, (0, 0), (5, 0)), queries(spark, (1, 100), (4, -100))
    assert picks(index.flat(metric, 16, 3).fit(r).transform(q)) == [0, 1]
    assert picks(index.hierarchical(metric, 16, 5, 3).fit(r).transform(q)) == [0, 1]
    with pytest.raises(Exception, match="finite"):
        index.flat(metric, 16, 3).fit(r).transform(queries(spark, (NAN, 0))).collect()
    with pytest.raises(ValueError, match="projection dimension"):
        index.hierarchical(metric, 16, 0, 3)
    with pytest.raises(ValueError, match="empty"):
        index.hierarchical(metric, 16, 2, 3).fit(r, sample=sample(spark))


def test_explicit_samples(spark):
    r = refs(spark, (0, 100), (4, -100))
    assert picks(index.flat("l1", 1, 0).fit(r, sample=sample(spark, (0, 3, 0.5))).transform(queries(spark, (3.5, 0)))) == [1]
    with pytest.raises(Exception, match="not valid"):
        index.flat("l1", 1, 0).fit(r, sample=sample(spark, (0, 0, 0.5))).transform(queries(spark, (3.5, 0))).collect()
    r = refs(spark, (0, 100, 0), (0, -100, 0), (4, 0, 2), (1, 0, 8))
    built = index.flat("l2", 1, 0).fit(r, sample=sample(spark, (0, 3, 0.7), (2, 2, 1.3)))
    q = ((0.2, NAN, 0.1), (3.8, 1000, 1.9), (1, -1000, 7.5), (0, 42, 0))
    x, w = np.array([(0, 0), (0, 0), (4, 2), (1, 8)], float), np.array([2.1, 2.6])
    want = [int((((x - np.array([a, c])) ** 2) * w).sum(axis=1).argmin()) for a, _, c in q]
    assert picks(built.transform(queries(spark, *q))) == want and want[-1] == 0
    assert tuple(built.space_usage().first()) == (4 * 2 * 4 + 2 * 8 + 2 * 4, 8, 2, 5)


def test_uniform(spark):
    r = refs(spark, (0, 0), (5, 5))
    built = index.uniform("l2", 4, 1).fit(r, mass=2.0)
    assert picks(built.transform(queries(spark, (1, 1), (4, 4)))) == [0, 1] and tuple(built.space_usage().first())[2:] == (2, 8)
    none = index.uniform("l1", 4, 1).fit(r, mass=0.0)
    assert picks(none.transform(queries(spark, (1, 1), (4, 4)))) == [0, 0] and none.space_usage().first().unique_coordinates == 0


@pytest.mark.parametrize("policy", ["relational", "blocked", "gram"])
def test_probabilities(spark, policy):
    values = lambda df: [r.prob for r in df.orderBy("j").collect()]
    if policy != "gram":
        assert np.allclose(values(sampling.importance_probabilities(refs(spark, (0, 0), (3, 4)), "l1", policy)), [3 / 7, 4 / 7])
    assert np.allclose(values(sampling.importance_probabilities(refs(spark, (0, 0), (3, 4)), "l2", policy)), [9 / 25, 16 / 25])
    assert values(sampling.importance_probabilities(refs(spark, (1, 1, 1), (1, 1, 1), (1, 1, 1)), "l2", policy)) == [0, 0, 0]
    x = np.array([(0, 0, 0, 0), (3, 4, 0, 0), (1, -2, 5, 0), (0, 0, 0, 0), (-4, 1, 2, 7)], float)
    for metric, power in (("l1", 1), ("l2", 2)):
        if policy == "gram" and metric == "l1":
            with pytest.raises(ValueError):
                sampling.importance_probabilities(refs(spark, *x), metric, policy)
            continue
        parts = [np.abs(a - b) ** power for k, a in enumerate(x) for b in x[k + 1 :] if (a != b).any()]
        assert np.allclose(values(sampling.importance_probabilities(refs(spark, *x), metric, policy)), np.max([p / p.sum() for p in parts], axis=0))
    near = 10_000 + np.array([(0, 0.5, 0, 0), (0, 0, 0.5, 0), (0.5, 0, 0, -0.5)])
    assert np.allclose(values(sampling.importance_probabilities(refs(spark, *near), "l2", policy)), values(sampling.importance_probabilities(refs(spark, *near), "l2")), atol=1e-6)


def test_mass_and_samples(spark):
    assert sampling.sampling_mass(probs(spark, 0.5, 0.25, 0, 0.25)).first().mass == 1.0
    assert {r.prob for r in sampling.uniform_probabilities(spark, 1.0, 4).collect()} == {0.25}
    for bad in (NAN, -0.1, 1.1):
        with pytest.raises(Exception, match="probability"):
            sampling.sampling_mass(probs(spark, 0.5, bad)).collect()
    with pytest.raises(ValueError):
        sampling.uniform_probabilities(spark, 3.0, 2)
    drawn = sampling.coordinate_sample(probs(spark, *[0.3] * 400, 0, 1), 20, 9)
    got = {r.j: r for r in drawn.collect()}
    mean = sum(r.multiplicity for j, r in got.items() if j < 400) / 400
    assert abs(mean - 6) < 0.4 and 400 not in got and got[401].multiplicity == 20
    more = {r.j: r.multiplicity for r in sampling.coordinate_sample(probs(spark, *[0.3] * 400, 0, 1), 30, 9).collect()}
    assert all(more[j] >= r.multiplicity for j, r in got.items())
    assert sampling.coordinate_sample(probs(spark, 1.0), 0, 9).count() == 0


def test_projection_statistics(spark):
    drawn = sample(spark, *[(j, 4, 0.25) for j in range(50)])
    coefs = np.array([r.coef for r in sampling.projection(drawn, "l2", 40, 1).collect()])
    assert abs(coefs.mean()) < 0.01 and abs(coefs.var() - 4 * 0.25 / 40) < 0.005
    cauchy = np.array([r.coef for r in sampling.projection(drawn, "l1", 40, 1).collect()])
    assert abs(np.median(np.abs(cauchy)) - 1) < 0.15


def test_more_repetitions_agree_more(spark):
    from nearfield.operators.datasets import synthetic

    r, q = synthetic(spark, 12, 48, 256, 32, seed=3)
    exact = index.exact(strategy="direct").fit(r).transform(q)
    assert metrics.basic_quality(exact, exact, q, r).first().label_correct == 48
    model = sampling.importance_probabilities(r, "l2", "blocked").cache()
    share = [metrics.basic_quality(index.flat("l2", t, 5).fit(r, model).transform(q), exact).first().agreeing for t in (1, 8, 64)]
    even = metrics.basic_quality(index.uniform("l2", 8, 5).fit(r, mass=sampling.sampling_mass(model).first()[0]).transform(q), exact).first().agreeing
    assert share[0] <= share[2] and share[2] >= 40 and share[1] >= even - 3


def test_worked_metrics(spark):
    table = metrics.distance_table(queries(spark, (0,), (1,), (3,), (10,)), refs(spark, (0,), (2,), (5,)), "l1").cache()
    g = metrics.geometry(metrics.optima(table)).first()
    assert (g.zero_optimum, g.non_unique, g.infinite_margins, g.margin_count) == (1, 1, 1, 3)
    assert (round(g.margin_mean, 9), g.margin_median, g.margin_p95) == (round(4.6 / 3, 9), 1.6, 2.0)
    assert [b.queries for b in metrics.buckets(metrics.optima(table)).orderBy("bucket").collect()] == [1, 0, 0, 0, 3]
    predicted = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "query_id bigint, ref_id bigint")
    judged = metrics.judged(predicted(0, 1, 0, 1), table)
    e = metrics.evaluate(judged).first()
    assert (e.optimal, e.non_optimal, e.ratio_count, e.ratio_max, e.ratio_p99) == (2, 2, 3, 3.0, 3.0)
    assert (round(e.ratio_mean, 9), e.non_optimal_ratio_mean, e.rank_mean, e.rank_p95) == (round(5.6 / 3, 9), 2.3, 1.75, 3)
    assert [x.violations for x in metrics.epsilon_failures(judged).collect()] == [2] * 6
    assert [(x.bucket, x.errors) for x in metrics.bucket_quality(judged).orderBy("bucket").collect() if x.queries] == [(0, 0), (4, 2)]
    bad = metrics.judged(predicted(1, 0, 1, 2), table)
    assert metrics.evaluate(bad).first().zero_optimum_misses == 1 and all(x.violations >= 1 for x in metrics.epsilon_failures(bad).collect())
    q, r = queries(spark, (0,), (1,), (3,), (10,)), refs(spark, (0,), (2,), (5,))
    s = metrics.evaluate(metrics.judged_selected(predicted(0, 1, 0, 1), predicted(0, 0, 1, 2), q, r, "l1")).first()
    assert (s.optimal, s.non_optimal, s.improvements, round(s.ratio_mean, 9)) == (2, 2, 0, round(5.6 / 3, 9)) and "rank_mean" not in s
    better = metrics.judged_selected(predicted(0).where("query_id = 0"), predicted(1), q.where("query_id = 0"), r, "l1")
    assert metrics.evaluate(better).first().improvements == 1
    empty = metrics.summary(table.limit(0), "dist").first()
    assert empty["count"] == 0 and empty["mean"] is None and empty["p95"] is None


def test_nearest_rank(spark):
    for n in (1, 2, 3, 4, 7, 20, 100, 101):
        row = metrics.summary(spark.range(1, n + 1).select(F.col("id").cast("double").alias("value"))).first()
        assert [row["median"], row["p95"], row["p99"]] == [float(-(-p * n // 100)) for p in (50, 95, 99)]


def test_expressions(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 9.0], [0.0, 1.0, 4.0, 4.0])], "a array<double>, b array<double>")
    vectors.register(spark)
    df.createOrReplaceTempView("v")
    a, b = F.col("a"), F.col("b")
    row = df.select(vectors.l1_distance(a, b), vectors.l2_distance_sq(a, b), vectors.median_abs_difference(a, b), vectors.dot(a, b), vectors.squared_norm(a)).first()
    assert tuple(row) == (12.0, 46.0, 3.0, 49.0, 111.0)
    row = spark.sql("select l1_distance(a, b), l2_distance_sq(a, b), median_abs_difference(a, b), vector_dot(a, b), l2_distance(a, b) from v").first()
    assert tuple(row) == (12.0, 46.0, 3.0, 49.0, 46.0**0.5)
    with pytest.raises(Exception, match="too large"):
        spark.range(1).select(vectors.narrowed(F.lit(1e300))).collect()


def test_save_load_and_stream(spark, tmp_path):
    r, q = refs(spark, (0, 0), (5, 0), (2, 4)), queries(spark, (1, 0), (3, 3), (2.5, 0))
    built = index.hierarchical("l2", 8, 4, 7).fit(r)
    want = picks(built.transform(q))
    built.save(str(tmp_path / "index"))
    loaded = index.NearestNeighborIndex.load(spark, str(tmp_path / "index"))
    assert picks(loaded.transform(q)) == want and loaded.settings == built.settings
    q.write.parquet(str(tmp_path / "queries"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "queries"))
    run = score(stream, loaded).writeStream.format("memory").queryName("scored").start()
    try:
        run.processAllAvailable()
        assert picks(spark.table("scored")) == want
    finally:
        run.stop()
    with pytest.raises(ValueError):
        score(q, loaded)
