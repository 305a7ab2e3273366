"""What the corpus operators share: the shared folder, lineage cuts, code shipping, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from nearfield.functions import shipping

_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, and where the session leaves Arrow batches at their default of 64 MiB has
    smaller ones: a worker holds several copies of a batch."""
    shipping.ship(spark)
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "4m")


def give_back() -> None:
    """Returns to the machine what this process's allocators keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, whose worker keeps little afterwards: it may wait long for another task."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (unit tests) a temporary folder is made and set; on a
    cluster that is an error, because its machines would not share that folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Alternates large-star and small-star rounds; each round keeps at most one row per edge, takes its
    minima with map-side partial aggregation and writes a reliable checkpoint. The number of rounds
    grows with the logarithm of the longest path. Only one row (a count and a checksum) comes to the
    driver per round. Null endpoints and self loops are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    # v is the smaller endpoint from here on
    current = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or state[0] == 0:
            break
        seen = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    children = current.groupBy("u").agg(F.min("v").alias("component"))
    roots = current.select(F.col("v").alias("u")).distinct().join(children.select("u"), "u", "left_anti")
    return children.union(roots.select("u", F.col("u").alias("component"))).select(F.col("u").alias("node"), "component")


def stretches(raw: bytes, length: int = 1 << 20):
    """``raw`` in parts of about ``length`` bytes that end before ASCII white space, so words stay whole."""
    at = 0
    while at < len(raw):
        end = at + length
        if end < len(raw):
            found = _BLANK.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def stored(df: DataFrame, name: str) -> DataFrame:
    """Computes ``df`` once and cuts its lineage by a Parquet table in the shared folder: smaller than a checkpoint."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(column: Column, kind: DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, StructType) else 8
        return F.greatest(F.size(column), F.lit(0)) * each + 24
    return F.lit(8)


def given(df: DataFrame, most_rows: int = 250_000, most_bytes: int = 32 << 20) -> DataFrame:
    """``df``, a computed table, to be broadcast if it has at most so many rows and bytes; else it is left to a shuffle."""
    if df.limit(most_rows + 1).count() > most_rows:
        return df
    size = df.agg(F.coalesce(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8)).cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


def executors_tidied(spark: SparkSession) -> None:
    """Lets the executors collect their garbage, after which their heaps shrink: Python workers need the memory of a
    machine that a heap, once grown, keeps. One small task for each slot; a slot that gets none keeps its heap."""
    slots = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, slots, 1, slots).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def dropped(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    tidied(spark)


def tidied(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles and broadcasts nothing refers to: Spark deletes them only after the driver
    has collected its garbage. What this process's allocators keep goes back as well."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
