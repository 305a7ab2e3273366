"""NPY matrices, probability files, digests, and the text and image sources of dataset preparation."""

from __future__ import annotations

import ast
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nearfield.functions.shipping import ship

# Fixed values of the file formats.
NPY_MAGIC = b"\x93NUMPY"
PROBABILITY_MAGIC = b"UHANNPR2"
PROBABILITY_KIND = {"l1": 1, "l2": 2}
_HEADER = struct.Struct("<8sB7xQQ32s")


def npy_shape(path: str, dtype: str, dimensions: int) -> tuple[tuple[int, ...], int]:
    """Shape and data offset of an NPY file that has exactly this type, rank, order and length; else an error."""
    with open(path, "rb") as file:
        if file.read(6) != NPY_MAGIC:
            raise ValueError(f"{path} is no NPY file")
        major = file.read(2)[0]
        if major not in (1, 2, 3):
            raise ValueError(f"{path} has an unknown NPY version")
        length = struct.unpack("<H", file.read(2))[0] if major == 1 else struct.unpack("<I", file.read(4))[0]
        if length > 1 << 20:
            raise ValueError(f"{path} has too long a header")
        header = ast.literal_eval(file.read(length).decode("latin-1"))
        at = file.tell()
    shape = header["shape"]
    if header["descr"] != dtype or header["fortran_order"] or len(shape) != dimensions:
        raise ValueError(f"{path} must hold {dtype} in C order with {dimensions} dimensions")
    if os.path.getsize(path) != at + int(np.prod(shape)) * np.dtype(dtype).itemsize:
        raise ValueError(f"{path} has another length than its header says")
    return shape, at


class NpySource(DataSource):
    """``spark.read.format("npy")``: (row_id, vec) of a float matrix or, with option labels, (row_id, label).

    Each partition maps its own rows; values that are not finite are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _labels(self) -> bool:
        return self.options.get("labels", "false") == "true"

    def schema(self) -> str:
        return "row_id bigint, label int" if self._labels() else "row_id bigint, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"], self._labels(), int(self.options.get("rows", 4096)))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, labels: bool, rows: int):
        self.path, self.labels, self.rows = path, labels, rows
        self.dtype = "<u2" if labels else "<f4"
        self.shape, self.at = npy_shape(path, self.dtype, 1 if labels else 2)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(0, max(1, self.shape[0]), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first = partition.value
        own = np.memmap(self.path, self.dtype, "r", self.at, self.shape)[first : first + self.rows] if self.shape[0] else np.zeros((0, *self.shape[1:]), self.dtype)
        ids = pa.array(np.arange(first, first + len(own)), pa.int64())
        if self.labels:
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32))], names=["row_id", "label"])
            return
        if not np.isfinite(own).all():
            raise ValueError(f"{self.path} has values that are not finite")
        offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * self.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(own).ravel()))], names=["row_id", "vec"])


def read_matrix(spark: SparkSession, path: str, id_col: str = "ref_id") -> DataFrame:
    ship(spark)
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path).withColumnRenamed("row_id", id_col)


def read_labels(spark: SparkSession, path: str, id_col: str = "ref_id") -> DataFrame:
    ship(spark)
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("labels", "true").load(path).withColumnRenamed("row_id", id_col)


def read_dataset(spark: SparkSession, folder: str, files: dict[str, str] | None = None, both_or_none: bool = False) -> tuple[DataFrame, DataFrame]:
    """(refs, queries) of a dataset folder, with labels.

    By default references without labels get their row number, query labels are needed and must exist among the
    references'. With ``both_or_none`` labels are on both sides or on neither; then there is no label column.
    """
    from nearfield.plans.setup import FILES

    path = {k: os.path.join(folder, v) for k, v in {**FILES, **(files or {})}.items()}
    refs, queries = read_matrix(spark, path["reference_vectors_file"]), read_matrix(spark, path["queries_file"], "query_id")
    (r, d), (m, e) = npy_shape(path["reference_vectors_file"], "<f4", 2)[0], npy_shape(path["queries_file"], "<f4", 2)[0]
    if not r or not d or d != e:
        raise ValueError("references must not be empty and queries must have their dimension")
    have = [os.path.exists(path[k]) for k in ("reference_labels_file", "query_labels_file")]
    if both_or_none and have[0] != have[1]:
        raise ValueError("labels must be on both sides or on neither")
    if both_or_none and not have[0]:
        return refs, queries
    if not have[1]:
        raise ValueError("query labels are missing")
    for k, n in (("reference_labels_file", r), ("query_labels_file", m)):
        if os.path.exists(path[k]) and npy_shape(path[k], "<u2", 1)[0][0] != n:
            raise ValueError("there are not as many labels as vectors")
    refs = refs.join(read_labels(spark, path["reference_labels_file"]), "ref_id") if have[0] else refs.withColumn("label", F.col("ref_id").cast("int"))
    queries = queries.join(read_labels(spark, path["query_labels_file"], "query_id"), "query_id")
    if not both_or_none and queries.join(refs.select("label"), "label", "left_anti").limit(1).count():
        raise ValueError("a query has a label that no reference has")
    return refs, queries


def write_npy(df: DataFrame, path: str, id_col: str = "ref_id") -> None:
    """A small matrix as an NPY file, in order of the id; put in place at once."""
    table = df.select(id_col, "vec").orderBy(id_col).toArrow()
    with open(path + ".new", "wb") as file:
        np.save(file, np.array(table.column("vec").to_pylist(), "<f4"))
    os.replace(path + ".new", path)


def sha256_file(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def sha256_of(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def digest(refs: DataFrame) -> str:
    """A digest of a reference set's ids and values that does not depend on the order of its rows.

    The rows' hashes are put together in 4,096 groups by their first three digits, and the groups' hashes in their
    order, so no task holds them all.
    """
    rows = refs.select(F.sha2(F.to_json(F.struct("ref_id", "vec")), 256).alias("h"))
    return _digest_of(_digest_of(rows, "h", F.substring("h", 1, 3)), "h").first()[0]


def _digest_of(rows: DataFrame, column: str, *by: Column) -> DataFrame:
    """(h): by group, the hash of the group's mark and its sorted hashes."""
    marks = [b.alias("mark") for b in by]
    whole = F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256)
    found = rows.groupBy(*marks).agg(whole.alias("h"))
    return found.select(F.concat("mark", "h").alias("h")) if by else found


def save_probabilities(probs: DataFrame, path: str, metric: str, refs: DataFrame) -> None:
    """Parquet with metric, shape and digest of the references on every row; refuses to overwrite."""
    from nearfield.operators.sampling import checked

    r = refs.count()
    rows = checked(probs).withColumns({"metric": F.lit(metric), "reference_vectors": F.lit(r), "digest": F.lit(digest(refs))})
    rows.coalesce(1).write.parquet(path)


def load_probabilities(spark: SparkSession, path: str, metric: str, refs: DataFrame) -> DataFrame:
    """(j, prob) that were saved for exactly these references and this metric; else an error."""
    rows = spark.read.parquet(path)
    kinds = rows.select("metric", "reference_vectors", "digest").distinct().collect()
    if len(kinds) != 1 or tuple(kinds[0]) != (metric, refs.count(), digest(refs)):
        raise ValueError(f"{path} was made for other references or another metric")
    return rows.select("j", "prob")


def write_probability_file(path: str, metric: str, references: int, sha256: str, probs: np.ndarray) -> None:
    """The binary form of a probability vector."""
    probs = np.asarray(probs, "<f8")
    if not ((probs >= 0) & (probs <= 1)).all():
        raise ValueError("a probability is not in [0, 1]")
    with open(path + ".new", "wb") as file:
        file.write(_HEADER.pack(PROBABILITY_MAGIC, PROBABILITY_KIND[metric], references, len(probs), bytes.fromhex(sha256)) + probs.tobytes())
    os.replace(path + ".new", path)


def read_probability_file(path: str) -> tuple[str, int, str, np.ndarray]:
    """(metric, references, sha256, probabilities) of a binary file; an error for any damage."""
    with open(path, "rb") as file:
        raw = file.read()
    if len(raw) < _HEADER.size or raw[9:16] != bytes(7):
        raise ValueError(f"{path} is no probability file")
    magic, kind, references, dimension, sha256 = _HEADER.unpack_from(raw)
    names = {v: k for k, v in PROBABILITY_KIND.items()}
    if magic != PROBABILITY_MAGIC or kind not in names:
        raise ValueError(f"{path} is no probability file")
    if len(raw) != _HEADER.size + 8 * dimension:
        raise ValueError(f"{path} has another length than its header says")
    probs = np.frombuffer(raw, "<f8", offset=_HEADER.size)
    if not ((probs >= 0) & (probs <= 1)).all():
        raise ValueError("a probability is not in [0, 1]")
    return names[kind], references, sha256.hex(), probs


def bound_probabilities(spark: SparkSession, path: str, metric: str, references: int, dimension: int, sha256: str) -> DataFrame:
    """(j, prob) of a binary probability file; an error if it was made for another metric, shape or source file."""
    kind, rows, digest_, probs = read_probability_file(path)
    if (kind, rows, len(probs), digest_) != (metric, references, dimension, sha256):
        raise ValueError(f"{path} was made for other references or another metric")
    return spark.createDataFrame(pa.table({"j": pa.array(np.arange(len(probs)), pa.int32()), "prob": probs}))


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """(feature_index, feature, sample, value) of tab-separated feature-major text, gzip or plain; the first line of each
    file names its samples. Line numbers come from one task a file, as gzip can't be split. Several files must have the
    same features in the same order; their samples are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[str] | None = None
        row = 0
        for batch in batches:
            rows: list[tuple[int, str, str, float]] = []
            for line in batch.column(0).to_pylist():
                name, *values = line.rstrip("\r\n").split("\t")
                if head is None:
                    head = values
                    continue
                if len(values) != len(head):
                    raise ValueError(f"row {row} has {len(values)} values for {len(head)} samples")
                rows += [(row, name, s, float(v)) for s, v in zip(head, values, strict=True)]
                row += 1
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["feature_index", "feature", "sample", "value"])

    ship(spark)
    schema = "feature_index bigint, feature string, sample string, value double"
    files = sorted(spark.read.text(path).inputFiles())
    tables = [spark.read.text(file).coalesce(1).mapInArrow(run, schema) for file in files]
    if len(tables) > 1:
        names = [t.select("feature_index", "feature").distinct().agg(F.count("*"), F.sum(F.xxhash64("feature_index", "feature").cast("decimal(38,0)"))).first() for t in tables]
        if len(set(names)) > 1:
            raise ValueError("the files have different features")
    return reduce(DataFrame.unionAll, tables)


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, cells) of a series matrix: ``!key`` lines, and the table between its begin and end marks."""
    lines = spark.read.text(path).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    meta = lines.where("value like '!%' and value not like '!series_matrix_table_%'").select(F.regexp_extract("value", "^!([^\\t]+)", 1).alias("key"), F.transform(F.slice(F.split("value", "\t"), 2, 1_000_000), lambda x: F.btrim(x, F.lit('"'))).alias("values"))
    marks = lines.agg(F.min(F.when(F.col("value") == "!series_matrix_table_begin", F.col("line"))).alias("b"), F.max(F.when(F.col("value") == "!series_matrix_table_end", F.col("line"))).alias("e"))
    body = lines.crossJoin(F.broadcast(marks)).where("line > b and line < e").withColumn("cells", F.transform(F.split("value", "\t"), lambda x: F.btrim(x, F.lit('"'))))
    head = body.where("line = b + 1").select(F.slice("cells", 2, 1_000_000).alias("samples"))
    rows = body.where("line > b + 1").crossJoin(F.broadcast(head))
    cells = rows.select((F.col("line") - F.col("b") - 2).alias("feature_index"), F.get("cells", F.lit(0)).alias("feature"), F.explode(F.arrays_zip("samples", F.slice("cells", 2, 1_000_000).alias("values"))).alias("c"))
    return meta, cells.select("feature_index", "feature", F.col("c.samples").alias("sample"), F.col("c.values").cast("double").alias("value"))


#: Fixed value: the columns of the clinical table.
CLINICAL = "patient_id string, geo_accession string, lymph_node_status string, follow_up_months double, relapse int, er_status string, brain_relapse int"


def clinical_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=CLINICAL, header=True)


def links(html: Column, pattern: str) -> Column:
    """The targets of links in a page that match a pattern."""
    return F.filter(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1), lambda x: x.rlike(pattern))


def ppm_pixels(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, maximum, values in [0, 1]) of a binary PPM image; two-byte values are big-endian. The header
    has one maximum, or one for each channel on one line, by which the channel is scaled."""
    fields: list[bytes] = []
    at = 0

    def more(count: int) -> None:
        nonlocal at
        while len(fields) < count:
            while at < len(raw) and raw[at : at + 1].isspace():
                at += 1
            if raw[at : at + 1] == b"#":
                at = raw.index(b"\n", at)
                continue
            end = at
            while end < len(raw) and not raw[end : end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("the image has no complete header")
            fields.append(raw[at:end])
            at = end

    more(4)
    if fields[0] != b"P6":
        raise ValueError("not a binary PPM image")
    width, height = map(int, fields[1:3])
    rest = re.match(rb"[ \t]+(\d+)[ \t]+(\d+)(?=\s)", raw[at:])
    if rest:  # a maximum for each channel
        fields += rest.groups()
        at += rest.end()
    maxima = np.array([int(f) for f in fields[3:]])
    kind = np.dtype(">u2" if maxima.max() > 255 else "u1")
    data = raw[at + 1 :]
    if not (0 < maxima.min() and maxima.max() < 65_536) or len(data) != width * height * 3 * kind.itemsize:
        raise ValueError("the image has another size than its header says")
    values = np.frombuffer(data, kind).reshape(-1, 3) / maxima.astype(np.float32)
    return width, height, int(maxima.max()), values.astype(np.float32).ravel()


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, vec) of the PPM images that match a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ppm_pixels(x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "width", "height", "vec"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, vec array<float>")


def extract_archive(path: str, folder: str, most_bytes: int = 1 << 32, most_files: int = 100_000) -> list[str]:
    """Extracts a tar archive's plain files below ``folder``; an error, before anything is written, for a path that
    leaves it, a link or device, a name that comes twice, or more bytes or files than allowed."""
    import tarfile

    top = os.path.realpath(folder)
    with tarfile.open(path) as archive:
        members = [m for m in archive if not m.isdir()]
        names = [os.path.realpath(os.path.join(top, m.name)) for m in members]
        if any(not m.isfile() for m in members) or any(not n.startswith(top + os.sep) for n in names):
            raise ValueError("the archive holds a member that may not be extracted")
        if len(set(names)) != len(names) or len(names) > most_files or sum(m.size for m in members) > most_bytes:
            raise ValueError("the archive holds a name twice, or too much")
        for m in members:
            archive.extract(m, top, filter="data")
    return sorted(names)
