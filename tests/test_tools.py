"""Matrix products, archives and the command line."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import matrix
from nearfield.plans import cli, summary
from nearfield.sources import storage


def test_products(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "row int, vec array<float>")
    b = spark.createDataFrame([(0, [7.0, 8.0, 9.0]), (1, [-1.0, 0.0, 1.0])], "col int, vec array<float>")
    assert {(r.row, r.col): r.value for r in matrix.product_transposed(a, b).collect()} == {(0, 0): 50, (0, 1): 2, (1, 0): 122, (1, 1): 2}
    with pytest.raises(Exception, match="inner dimensions"):
        matrix.product_transposed(a, spark.createDataFrame([(0, [1.0])], b.schema)).collect()
    big, ones = np.array([[16_777_216.0, 1.0, -16_777_216.0]]), np.ones((1, 3))
    assert matrix.product_transposed_fp32(big, ones)[0, 0] == 0 and (big @ ones.T)[0, 0] == 1
    with pytest.raises(OverflowError):
        matrix.product_transposed_fp32(np.array([[1e300]]), np.ones((1, 1)))
    with pytest.raises(ValueError):
        matrix.product_transposed_fp32(big, np.ones((1, 2)))


def tar(path, *names, link=False):
    with tarfile.open(path, "w:gz") as archive:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 3
            if link:
                info.type, info.linkname, info.size = tarfile.SYMTYPE, "/etc/passwd", 0
            archive.addfile(info, io.BytesIO(b"abc"))
    return str(path)


def test_archives(tmp_path):
    (tmp_path / "out").mkdir()
    found = storage.extract_archive(tar(tmp_path / "a.tgz", "d/x", "y"), str(tmp_path / "out"))
    assert [f.rpartition("out/")[2] for f in found] == ["d/x", "y"] and (tmp_path / "out/d/x").read_bytes() == b"abc"
    for bad, link in ((("../x",), False), (("x", "x"), False), (("x",), True)):
        with pytest.raises(ValueError):
            storage.extract_archive(tar(tmp_path / "b.tgz", *bad, link=link), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        storage.extract_archive(tar(tmp_path / "c.tgz", "x"), str(tmp_path / "out"), most_bytes=2)


def test_command_line(spark, tmp_path, capsys):
    np.save(tmp_path / "reference_vectors.npy", np.array([(0, 0), (3, 4)], "<f4"))
    np.save(tmp_path / "queries.npy", np.array([(0, 1), (3, 3), (2, 4)], "<f4"))
    out = str(tmp_path / "p.bin")
    assert cli.main(["probabilities", "--input", str(tmp_path / "reference_vectors.npy"), "--output", out]) == 0
    metric, rows, sha, probs = storage.read_probability_file(out)
    assert (metric, rows) == ("l2", 2) and np.allclose(probs, [9 / 25, 16 / 25]) and sha in capsys.readouterr().out
    text = f"benchmark_setup_v2\ndataset\t{tmp_path}\njson_output\to.json\ncsv_output\to.csv\nreference\te\nwarmups\t0\ntrials\t1\nrun\te\texact\nrun\tf\tflat\trepetitions=8\tseed=1\n"
    (tmp_path / "s.tsv").write_text(text)
    assert cli.main(["run", "--setup", str(tmp_path / "s.tsv"), "--validate-only"]) == 0
    assert cli.main(["sweep", "--setup", str(tmp_path / "s.tsv"), "--dry-run"]) == 0 and "would run" in capsys.readouterr().out
    assert cli.main(["run", "--setup", str(tmp_path / "s.tsv")]) == 0 and (tmp_path / "o.json").exists()
    assert cli.main(["sweep", "--setup", str(tmp_path / "s.tsv")]) == 0 and "agree" in capsys.readouterr().out


def test_flattened_quality(spark):
    rows = spark.createDataFrame(
        [("a", (3, 1.5), [(0.05, 0.5), (0.1, 0.25)]), ("b", None, [])],
        "name string, distance_ratio struct<count:int,mean:double>, failures array<struct<epsilon:double,rate:double>>",
    )
    out = summary.flattened(rows, "failures", [0.001, 0.05, 0.1])
    ends = ["0_001", "0_05", "0_10"]
    assert out.columns == ["name", "distance_ratio_count", "distance_ratio_mean", *(f"approximation_failure_rate_epsilon_{e}" for e in ends)]
    assert [tuple(r) for r in out.orderBy("name").collect()] == [("a", 3, 1.5, None, 0.5, 0.25), ("b", None, None, None, None, None)]


def test_matrix_summary_defined_cases(spark):
    rows = spark.createDataFrame([([1.0, float("nan"), -2.0],), ([float("inf"), None],), (None,), ([],)], "vec array<double>")
    assert tuple(summary.matrix_summary(rows).first()) == (4, 0, 3, -2.0, 1.0, 3)
    assert tuple(summary.matrix_summary(rows.limit(0)).first()) == (0, None, None, None, None, 0)


def test_lines_csv_and_digest(spark, tmp_path):
    rows = spark.createDataFrame([("flat", 8, None, [1, 2]), ("hierarchical", 8, 16, [3]), ("uniform", 16, None, [4])], "index string, repetitions int, projection_dimension int, seeds array<int>")
    assert summary.line_rows(rows, "both", [8], [16], most=2).count() == 2 and summary.line_rows(rows, "uniform", most=1).count() == 1
    for choice, most in (("exact", 3), ("all", 2)):
        with pytest.raises(ValueError):
            summary.line_rows(rows, choice, most=most)
    summary.write_csv(rows, str(tmp_path / "a"))
    back = spark.read.option("header", True).csv(str(tmp_path / "a"))
    assert sorted(r.seeds for r in back.collect()) == ["1;2", "3", "4"]
    refs = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(300)], "ref_id bigint, vec array<double>")
    first = storage.digest(refs)
    assert first == storage.digest(refs.orderBy(F.desc("ref_id")).repartition(5)) != storage.digest(refs.where("ref_id > 0"))
