"""Dataset preparation, sources, setups, the runner and report aggregation."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import datasets
from nearfield.plans import runner, setup, summary
from nearfield.sources import storage


def test_split_never_straddles_groups(spark):
    rows = [(k, k // 3, (k // 3) % 4) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id bigint, person int, label int")
    split = datasets.stratified_split(df, 0.7, 1, group="person").collect()
    roles = {}
    for r in split:
        assert roles.setdefault(r.person, r.role) == r.role
    assert len(split) == 240 and all(sum(1 for p, role in roles.items() if p % 4 == n and role == "pool") == 14 for n in range(4))
    two = df.union(spark.createDataFrame([(999, 0, 1)], df.schema))
    with pytest.raises(Exception, match="two labels"):
        datasets.stratified_split(two, 0.7, 1, group="person").collect()


def test_holdout_and_parsing(spark):
    df = spark.createDataFrame([(0,), (90,), (180,), (270,)], "angle int")
    assert [r.angle for r in df.where(datasets.cyclic_holdout(F.col("angle"), 270, 2, 90)).collect()] == [0, 270]
    df = spark.createDataFrame([("TCGA-AB-1234-01A", "x/obj3__45.ppm"), ("bad", "obj3_45.ppm")], "b string, f string")
    got = df.select(datasets.sample_parts(F.col("b")).alias("b"), datasets.image_parts(F.col("f")).alias("f")).collect()
    assert (got[0].b.participant, got[0].b.sample_type, got[0].f.object, got[0].f.angle) == ("TCGA-AB-1234", "01", 3, 45) and got[1].b is None and got[1].f is None
    samples = spark.createDataFrame([("A", "01"), ("A", "03"), ("L", "03"), ("L", "01")], "project_id string, sample_type string")
    assert {tuple(r) for r in datasets.kept_sample_types(samples, {"L": ["03"]}).collect()} == {("A", "01"), ("L", "03")}


def test_normaliser(spark):
    x = np.array([(1, 5, 2), (3, 5, 4), (8, 5, 0)], float)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, vec array<float>")
    got = np.array([r.vec for r in datasets.normalise(df, datasets.fit_normaliser(df)).orderBy("vec_id").collect()])
    scale = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    assert np.allclose(got, (x - x.mean(axis=0)) / scale, atol=1e-6)


def test_sub_centroids(spark):
    pool = [(k, (3, 3, 8, 8)[k % 4], [(0.5 if k < 4 else 10.5) + (100 if k % 4 > 1 else 0) + j + (0.1 if k % 2 else -0.1) for j in range(4)]) for k in range(8)]
    df = spark.createDataFrame(pool, "vec_id bigint, label int, vec array<float>")
    got = sorted((r.label, round(r.vec[0], 3), r.size) for r in datasets.sub_centroids(df, 2, 2, seed=7).collect())
    assert got == [(3, 0.5, 2), (3, 10.5, 2), (8, 100.5, 2), (8, 110.5, 2)]
    with pytest.raises(Exception, match="fewer rows"):
        datasets.sub_centroids(df, 5).collect()


def test_kmeans_repairs_empty_clusters():
    own = datasets.kmeans(np.zeros((6, 2)), 3, 10, 1)
    assert len(set(own.tolist())) == 3


def test_synthetic_rejects_far_interpolations(spark):
    with pytest.raises(ValueError):
        datasets.synthetic(spark, 6, 6, 96, 12, interpolations=(0.5,))


def npy(path, array, version=None):
    np.save(path, array)
    return str(path)


def test_npy_and_dataset_rules(spark, tmp_path):
    r = npy(tmp_path / "reference_vectors.npy", np.array([(1, 2, 3), (4, 5, 6)], "<f4"))
    npy(tmp_path / "queries.npy", np.array([(1, 1, 1), (5, 5, 5), (2, 2, 2)], "<f4"))
    assert [x.vec for x in storage.read_matrix(spark, r).orderBy("ref_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError, match="query labels"):
        storage.read_dataset(spark, str(tmp_path))
    assert "label" not in storage.read_dataset(spark, str(tmp_path), both_or_none=True)[0].columns
    npy(tmp_path / "query_labels.npy", np.array([0, 1, 0], "<u2"))
    refs, queries = storage.read_dataset(spark, str(tmp_path))
    assert sorted(x.label for x in refs.collect()) == [0, 1] and [x.label for x in queries.orderBy("query_id").collect()] == [0, 1, 0]
    with pytest.raises(ValueError, match="both sides"):
        storage.read_dataset(spark, str(tmp_path), both_or_none=True)
    npy(tmp_path / "reference_labels.npy", np.array([4, 7], "<u2"))
    with pytest.raises(ValueError, match="no reference has"):
        storage.read_dataset(spark, str(tmp_path))
    npy(tmp_path / "query_labels.npy", np.array([4, 7], "<u2"))
    with pytest.raises(ValueError, match="as many labels"):
        storage.read_dataset(spark, str(tmp_path))
    for bad, match in ((np.zeros((2, 2)), "must hold"), (np.zeros(2, "<f4"), "must hold"), (np.asfortranarray(np.zeros((2, 3), "<f4")), "must hold")):
        with pytest.raises(Exception, match=match):
            storage.read_matrix(spark, npy(tmp_path / "bad.npy", bad)).collect()
    npy(tmp_path / "bad.npy", np.array([[np.nan]], "<f4"))
    with pytest.raises(Exception, match="finite"):
        storage.read_matrix(spark, str(tmp_path / "bad.npy")).collect()
    with open(r, "ab") as file:
        file.write(b"x")
    with pytest.raises(Exception, match="another length"):
        storage.read_matrix(spark, r).collect()


def test_probability_files(spark, tmp_path):
    path = str(tmp_path / "p.bin")
    storage.write_probability_file(path, "l2", 3, "ab" * 32, np.array([0.0, 0.5, 1.0]))
    metric, count, sha, probs = storage.read_probability_file(path)
    assert (metric, count, sha, probs.tolist()) == ("l2", 3, "ab" * 32, [0.0, 0.5, 1.0])
    raw = open(path, "rb").read()
    for damaged in (raw[:-1], raw + b"x", b"X" + raw[1:], raw[:20]):
        open(path, "wb").write(damaged)
        with pytest.raises(ValueError):
            storage.read_probability_file(path)
    with pytest.raises(ValueError):
        storage.write_probability_file(path, "l1", 1, "ab" * 32, np.array([1.5]))
    refs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "ref_id bigint, vec array<float>")
    model = spark.createDataFrame([(0, 0.5), (1, 0.5)], "j int, prob double")
    storage.save_probabilities(model, str(tmp_path / "model"), "l2", refs)
    assert storage.load_probabilities(spark, str(tmp_path / "model"), "l2", refs.repartition(2)).count() == 2
    with pytest.raises(ValueError):
        storage.load_probabilities(spark, str(tmp_path / "model"), "l1", refs)
    with pytest.raises(ValueError):
        storage.load_probabilities(spark, str(tmp_path / "model"), "l2", refs.limit(1))
    open(path, "wb").write(b"abc")
    assert storage.sha256_file(path) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_text_and_image_sources(spark, tmp_path):
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as file:
        file.write("Ensembl_ID\ts1\ts2\ng1\t1\t2\ng2\t3\t4\n")
    cells = storage.feature_table(spark, str(tmp_path / "m.tsv.gz"))
    got = datasets.transpose(cells, "feature_index").orderBy("sample").collect()
    assert [(r.sample, r.vec) for r in got] == [("s1", [1, 3]), ("s2", [2, 4])]
    (tmp_path / "series.txt").write_text('!Series_title\t"x"\n!series_matrix_table_begin\n"ID_REF"\t"a"\t"b"\n"p1"\t1.5\t2\n"p2"\t3\t4\n!series_matrix_table_end\n')
    meta, cells = storage.series_matrix(spark, str(tmp_path / "series.txt"))
    assert [tuple(r) for r in meta.collect()] == [("Series_title", ["x"])]
    assert {tuple(r) for r in cells.collect()} == {(0, "p1", "a", 1.5), (0, "p1", "b", 2.0), (1, "p2", "a", 3.0), (1, "p2", "b", 4.0)}
    (tmp_path / "clinical.tsv").write_text("# note\nPID\tGEO\tL\tM\tR\tER\tB\np1\tg1\tneg\t10.5\t1\tER+\t0\n")
    assert storage.clinical_table(spark, str(tmp_path / "clinical.tsv")).first().follow_up_months == 10.5
    (tmp_path / "a.ppm").write_bytes(b"P6\n# c\n2 1\n65535\n" + np.array([0, 65535, 13107] * 2, ">u2").tobytes())
    row = storage.images(spark, str(tmp_path / "*.ppm")).first()
    assert (row.width, row.height) == (2, 1) and np.allclose(row.vec, [0, 1, 0.2] * 2)
    for bad in (b"P5\n1 1\n255\n\x00", b"P6\n1 1\n255\n\x00\x00", b"P6\n1"):
        with pytest.raises(ValueError):
            storage.ppm_pixels(bad)


GOOD = "my_benchmark_setup_v2\n# note\n\ndataset\tdata\njson_output\to.json\ncsv_output\to.csv\nreference\te\n{}run\te\texact\n{}"


def test_setup_accepts(tmp_path):
    s = setup.parse(GOOD.format("distance\tl2\nbatch_sizes\t1,8\n", "run\tf\tflat\trepetitions=8\tseed=1\nrun\th\thierarchical\tbackend=cuda\trepetitions=8\tseed=1\tprojection_dimension=4\n"), "/x/setup.tsv")
    assert s.dataset == "/x/data" and [r.name for r in s.ordered()] == ["e", "f", "h"] and [r.strategy for r in s.runs] == ["sequential", "sequential", "gemm"]
    assert setup.parse(GOOD.format("probabilities\tp\n", "")).probability_policy == "load"
    assert setup.parse(GOOD.format("distance\tl1\n", "run\tf\tflat\tbackend=cuda\trepetitions=8\tseed=1\n")).runs[1].strategy == "direct"


@pytest.mark.parametrize(
    ("globals_", "runs"),
    [
        ("distance\tl3\n", ""), ("unknown\tx\n", ""), ("trials\t0\n", ""), ("trials\t2\ntrials\t2\n", ""), ("batch_sizes\t1,0\n", ""), ("probability_policy\tload\n", ""),
        ("distance\tl1\nprobability_policy\tgpu_cublas_fp32\n", ""), ("", "run\te\texact\n"), ("", "run\tf\tflat\tseed=1\n"), ("", "run\tf\texact\tseed=1\n"),
        ("", "run\tf\thierarchical\trepetitions=1\tseed=1\n"), ("", "run\tf\tflat\trepetitions=1\tseed=1\tbad=1\n"), ("", "run\tf\tflat\trepetitions=1\tseed=1\tseed=1\n"),
        ("distance\tl1\n", "run\tf\tflat\trepetitions=1\tseed=1\tstrategy=automatic\n"), ("distance\tl1\n", "run\tf\tflat\tbackend=cuda\tstrategy=gemm\trepetitions=1\tseed=1\n"), ("", "run\tf\tother\n"),
    ],
)
def test_setup_rejects(globals_, runs):
    with pytest.raises(setup.SetupError):
        setup.parse(GOOD.format(globals_, runs))


def test_setup_needs_version_and_reference():
    for text in ("", "other_v1\n", GOOD.format("", "").replace("reference\te", "reference\tz"), GOOD.format("", "").replace("dataset\tdata\n", "")):
        with pytest.raises(setup.SetupError):
            setup.parse(text)


@pytest.mark.parametrize("diagnostics", ["selected_distances", "full_distance_table"])
def test_runner(spark, tmp_path, diagnostics):
    refs, queries = datasets.synthetic(spark, 6, 12, 48, 12)
    s = setup.parse(GOOD.format(f"diagnostics\t{diagnostics}\nwarmups\t0\ntrials\t2\nbatch_sizes\t4,99\n", "run\tf\tflat\trepetitions=32\tseed=1\nrun\tu\tuniform\trepetitions=4\tseed=1\n"))
    report = runner.validated(runner.run(s, refs, queries))
    assert [r["name"] for r in report["runs"]] == ["e", "f", "u"] and report["runs"][0]["quality"]["agreeing"] == 12
    assert [m["batch_size"] for m in report["runs"][0]["measurements"]] == [4, 12] and report["runs"][0]["approximation"]["optimal"] == 12
    runner.write_report(report, str(tmp_path / "o.json"), str(tmp_path / "o.csv"))
    assert json.loads((tmp_path / "o.json").read_text())["schema_version"] == 6 and len((tmp_path / "o.csv").read_text().splitlines()) == 1 + 3 * 2 * 2
    with pytest.raises(ValueError):
        runner.validated(report | {"schema_version": 5})
    with pytest.raises(ValueError):
        runner.validated(report | {"reference": "f"})


def test_summaries(spark):
    kind = "name string, index string, backend string, strategy string, repetitions int, projection_dimension int, seed int, batch_size int, us_per_query double, agreement double, index_bytes bigint, unique_coordinates bigint, total_multiplicity bigint"
    runs = spark.createDataFrame(
        [("e", "exact", "c", "s", None, None, None, 1, 100.0, 1.0, 1000, 10, 10), ("f1", "flat", "c", "s", 8, None, 1, 1, 10.0, 0.9, 0, 5, 16), ("f2", "flat", "c", "s", 8, None, 2, 1, 20.0, 0.8, 100, 5, 16), ("h", "hierarchical", "c", "s", 8, 4, 1, 1, 8.0, 0.7, 50, 5, 16)],
        kind,
    )
    rows = {r.name: r for r in summary.with_exact(runs, 10).collect()}
    assert (rows["f1"].speedup, rows["f1"].compression, rows["f2"].compression, rows["f1"].mass_estimate, rows["f1"].dimension_fraction) == (10.0, None, 10.0, 2.0, 0.5)
    flat = summary.across_seeds(runs.where("index != 'exact'"), ["index"]).orderBy("index").collect()
    assert flat[0].seeds == [1, 2] and round(flat[0].us_per_query_stddev, 6) == round(50**0.5, 6) and flat[1].us_per_query_stddev == 0
    (pair,) = summary.hierarchical_against_flat(runs).collect()
    assert pair.delta_us == -2.0
    with pytest.raises(Exception, match="other coordinates"):
        summary.hierarchical_against_flat(runs.withColumn("unique_coordinates", F.when(F.col("index") == "flat", 6).otherwise(F.col("unique_coordinates")))).collect()
    assert [r.name for r in summary.pareto(runs, "us_per_query", "agreement", True).orderBy("us_per_query").collect()] == ["h", "f1", "e"]
    report = spark.createDataFrame([("e", True, 1, [1.0, 3.0]), ("a", False, 1, [2.0])], "name string, reference boolean, batch_size int, trial_ms array<double>")
    other = spark.createDataFrame([("e", True, 1, [8.0]), ("b", False, 1, [2.0, 4.0])], report.schema)
    assert {r.name: r.median_ms for r in summary.joined([report, other]).collect()} == {"e": 3.0, "a": 2.0, "b": 3.0}
    with pytest.raises(Exception, match="same name"):
        summary.joined([report, report]).collect()
    assert summary.trial_rows(report).count() == 3
    assert spark.range(1).select(summary.effective_batches(F.array(F.lit(1), F.lit(50), F.lit(99)), 20).alias("b")).first().b == [1, 20]


def test_inventory_and_alignment(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("aabc", "abd"))
    assert {tuple(r) for r in datasets.inventory(a, b).collect()} == {("a", "extra"), ("c", "extra"), ("d", "missing")}
    assert {r.k for r in datasets.aligned(a, b, "k").collect()} == {"a", "c", "d"}
    assert datasets.duplicates(a, "k").first().k == "a"


def test_images_with_a_maximum_for_each_channel():
    raw = b"P6\n# a comment\n2 1\n255 100 50\n" + bytes([255, 50, 25, 51, 100, 50])
    assert storage.ppm_pixels(raw)[:3] == (2, 1, 255)
    assert np.allclose(storage.ppm_pixels(raw)[3], [1, 0.5, 0.5, 0.2, 1, 1])
    with pytest.raises(ValueError, match="another size"):
        storage.ppm_pixels(raw + b"x")


def test_feature_table_of_several_files(spark, tmp_path):
    for name, samples, values in (("a", "s1\ts2", [(1, 2), (3, 4)]), ("b", "s3", [(5,), (6,)])):
        rows = [f"g{k}\t" + "\t".join(map(str, v)) for k, v in enumerate(values)]
        (tmp_path / f"{name}.tsv").write_text("\n".join(["id\t" + samples, *rows]) + "\n")
    got = {(r.feature_index, r.feature, r["sample"]): r.value for r in storage.feature_table(spark, str(tmp_path)).collect()}
    assert got == {(0, "g0", "s1"): 1, (0, "g0", "s2"): 2, (1, "g1", "s1"): 3, (1, "g1", "s2"): 4, (0, "g0", "s3"): 5, (1, "g1", "s3"): 6}
    (tmp_path / "c.tsv").write_text("id\ts4\nother\t1\n")
    with pytest.raises(ValueError, match="different features"):
        storage.feature_table(spark, str(tmp_path))


def test_probability_file_is_bound_to_its_source(spark, tmp_path):
    path = str(tmp_path / "p.bin")
    storage.write_probability_file(path, "l2", 3, "ab" * 32, np.array([0.5, 1.0]))
    assert [tuple(r) for r in storage.bound_probabilities(spark, path, "l2", 3, 2, "ab" * 32).orderBy("j").collect()] == [(0, 0.5), (1, 1.0)]
    for wrong in (("l1", 3, 2, "ab" * 32), ("l2", 4, 2, "ab" * 32), ("l2", 3, 3, "ab" * 32), ("l2", 3, 2, "cd" * 32)):
        with pytest.raises(ValueError, match="other references"):
            storage.bound_probabilities(spark, path, *wrong)
