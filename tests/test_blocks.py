"""What is beyond one broadcast: several blocks of references give what one gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import datasets, index, metrics, sampling, scan


@pytest.fixture(scope="module")
def sides(spark):
    made = np.random.default_rng(5).integers(-3, 4, (70, 12)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(made)], "id bigint, vec array<float>, label int")
    rows = rows.withColumn("vec", F.col("vec").cast("array<float>")).cache()
    return rows.where("id < 30").withColumnRenamed("id", "ref_id"), rows.where("id >= 20").withColumnRenamed("id", "query_id")


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_blocks_are_merged(sides, metric, monkeypatch):
    r, q = sides

    def all_of():
        found = scan.nearest(q, r, metric, "direct")
        predicted = q.select("query_id", (F.col("query_id") % 30).alias("ref_id"))
        built = index.flat(metric, 8, 1, "direct").fit(r)
        return [rows(x) for x in (found, metrics.distance_table(q, r, metric), metrics.optima_of(q, r, metric), metrics.judged_of(predicted, q, r, metric), datasets.nearest_rivals(r), built.transform(q))]

    one = all_of()
    table = metrics.distance_table(q, r, metric).cache()
    assert one[0] == rows(scan.nearest(q, r, metric, "relational")) == rows(scan.nearest(q, r, metric, "array_scan"))
    assert one[2] == rows(metrics.optima(table)) and one[3] == rows(metrics.judged(q.select("query_id", (F.col("query_id") % 30).alias("ref_id")), table))
    monkeypatch.setattr(scan, "_BLOCK_BYTES", 12 * 8 * 7)
    assert scan.blocks_for(scan.measured(r)) == 5 and all_of() == one
    assert rows(scan.nearest(q, r, metric, "relational")) == one[0]  # too large for one broadcast: goes another way


@pytest.mark.parametrize("metric,policy", [("l1", "blocked"), ("l2", "blocked"), ("l2", "gram")])
def test_probabilities_of_pairs_of_blocks(sides, metric, policy, monkeypatch):
    r, _ = sides
    want = rows(sampling.importance_probabilities(r, metric, "relational"))
    monkeypatch.setattr(sampling, "_BROADCAST_BYTES", 1)
    monkeypatch.setattr(sampling._paired, "__defaults__", (12 * 8 * 7,))
    got = rows(sampling.importance_probabilities(r, metric, policy))
    assert [j for j, _ in got] == [j for j, _ in want] and np.allclose([p for _, p in got], [p for _, p in want], rtol=1e-12)
    assert rows(sampling.importance_probabilities(r.limit(1), metric, policy)) == [(j, 0.0) for j in range(12)]


def test_vectors_that_do_not_fit(spark, sides):
    r, _ = sides
    for bad in ([[1.0] * 11, [1.0] * 13], [None], [[1.0] * 11]):
        q = spark.createDataFrame([(k, v) for k, v in enumerate(bad)], "query_id bigint, vec array<float>").coalesce(1)
        with pytest.raises(Exception, match="sizes differ|is null"):
            scan.nearest(q, r, "l2", "direct").collect()
    none = spark.createDataFrame([], "query_id bigint, vec array<float>")
    assert scan.nearest(none, r, "l2", "direct").count() == 0


def test_medians(spark):
    for n in (1, 2, 5, 6):
        x = np.random.default_rng(n).normal(size=(9, n))
        q, r = x[:4], x[4:]
        got = np.concatenate(list(scan.summed(r, "median")(q)))
        assert np.allclose(got, np.median(np.abs(q[:, None] - r), axis=2))


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_role_numbers(spark, parts):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("sample_index"), F.when(F.col("id") % 50 == 0, "query").otherwise("pool").alias("role"))
    got = datasets.role_index(df, parts=parts).toPandas()
    for _, own in got.groupby("role"):
        assert own.sort_values("sample_index").role_row_index.tolist() == list(range(len(own)))
    assert datasets.role_index(df.limit(0)).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_split_by_parts_of_hashes(spark, digits, monkeypatch):
    monkeypatch.setattr(datasets, "_DIGITS", digits)
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 2, 1).when(F.col("id") == 2, 2).otherwise(0).alias("label"))
    got = datasets.stratified_split(df, 0.7, 3).toPandas()
    shares = got.groupby("label").role.apply(lambda x: (x == "pool").sum()).to_dict()
    assert shares == {0: round(397 * 0.7), 1: 1, 2: 1}
    order = got[got.label == 0].assign(h=lambda x: [__import__("hashlib").md5(f"3|{v}".encode()).hexdigest() for v in x.vec_id]).sort_values("h")
    assert (order.role == "pool").tolist() == [True] * 278 + [False] * 119
