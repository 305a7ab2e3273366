"""Near copies by the Jaccard similarity of their word shingles: candidates by SimHash and banded min-hashes, an exact check.

Fingerprints within ``max_bits`` of each other come first, found by :func:`simhash.links`. A 64-bit SimHash can't be the
only filter at a similarity of 0.8: such pairs differ in about ten bits, with a deviation of three, and a bound that
lets them through has segments of four bits. Bands of min-hashes find the pairs beyond the bound, with probability
``1 - (1 - s**rows)**bands`` and need equi-joins only.

Texts with equal sets of shingles are one node. The nodes of a bucket are compared with one of them in some rounds, in
which large groups become one component. Of the pairs of a bucket that are still in different components only those
leave the join whose parity bitmaps allow the similarity: a bit is 1 if an odd number of shingles fall on it, so two
bitmaps differ in at most as many bits as the sets in shingles, and no similar pair is lost. Every pair that shares a
bucket is in one component or was ruled out or checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import simhash
from nearfield.llm.common import connected_components, cut, dropped, given, lean, ship, stored, tidied
from nearfield.llm.substring import _mix, shingle_hashes

_BLOCK = 1 << 8
_ROWS = 1 << 9
_WORDS = 32  # 64-bit words of a parity bitmap
_BITS = [f"bits{k}" for k in range(_WORDS)]


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes, sorted; a text with fewer words is one shingle, a blank one has none."""
    found = shingle_hashes(text, shingle)
    if not len(found):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    return np.unique(found)


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """64-bit words whose bits tell where an odd number of tokens fall."""
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % (64 * _WORDS), minlength=64 * _WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def band_keys(tokens: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: a hash of ``rows`` minima and the band's number."""
    count = bands * rows
    places = np.arange(1, count + 1, dtype=np.uint64)
    factors, offsets = _mix(places) | np.uint64(1), _mix(places + np.uint64(1 << 32))
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), _BLOCK):
        part = tokens[k : k + _BLOCK, None] * factors[None, :] + offsets[None, :]
        least = np.minimum(least, part.min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that little of what is computed for them is held at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _prints(rows: DataFrame, kind: str, shingle: int, bands: int, per_band: int) -> DataFrame:
    """(id, doc, node, size, fingerprint, keys) of rows (id, doc, text): a hash of the set of shingles, its size, its
    SimHash, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(tokens.tobytes()))
                sizes.append(len(tokens))
                prints.append(simhash.of_hashes([tokens]))
                keys.append(band_keys(tokens, bands, per_band).view(np.int64) if len(tokens) else [])
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "doc", "node", "size", "fingerprint", "keys"])

    return rows.mapInArrow(lean(run), f"id {kind}, doc bigint, node bigint, size int, fingerprint bigint, keys array<bigint>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles, and the words of its parity bitmap) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = [shingle_set(text.as_py(), shingle) for text in batch.column(0)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            bits = np.array([parity_bitmap(s) for s in sets], np.int64).reshape(len(sets), _WORDS)
            columns = [pa.array(nodes.view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(bits.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", *_BITS])

    return texts.select("text").mapInArrow(lean(run), "node bigint, shingles array<bigint>" + "".join(f", {b} bigint" for b in _BITS))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _near_prints(classes: DataFrame, max_bits: int, similarity: float) -> DataFrame:
    """(a, b): nodes whose SimHashes differ in ``max_bits`` at most and whose sizes allow the similarity. Of the nodes of
    one fingerprint the least stands for all: it is paired with each of them and with those of other fingerprints."""
    nodes = classes.where("size > 0").select("fingerprint", "node", "size")
    firsts = cut(nodes.groupBy("fingerprint").agg(F.min(F.struct("node", "size")).alias("first")))
    same = nodes.join(firsts, "fingerprint").select(F.col("first.node").alias("a"), F.col("first.size").alias("m"), F.col("node").alias("b"), F.col("size").alias("n")).where("a != b")
    found = cut(simhash.links(firsts.select("fingerprint"), max_bits, max_bits + 1).select("a", "b"))
    side = lambda name, node, size: firsts.select(F.col("fingerprint").alias(name), F.col("first.node").alias(node), F.col("first.size").alias(size))
    between = found.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b").select(F.col("p").alias("a"), "m", F.col("q").alias("b"), "n")
    pairs = same.union(between).where(F.least("m", "n") >= similarity * F.greatest("m", "n"))
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _components(spark, buckets: DataFrame, sets: DataFrame, similarity: float, rounds: int, tested: DataFrame) -> DataFrame:
    """(node, component) of the nodes that a verified pair links, those of ``tested`` first; every pair of a bucket is
    in one component or was compared. ``buckets`` has (key, node, size)."""
    fits = F.least("size", "other_size") >= similarity * F.greatest("size", "other_size")
    ends = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    parts = spark.createDataFrame([], "node bigint, component bigint")
    links = cut(_linked(tested, sets, similarity))
    if not links.isEmpty():
        parts = _merged(parts, links)
    for k in range(rounds + 1):
        labelled = buckets.join(parts, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("label"))
        open_keys = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64("label", F.lit(k)).alias("draw"), "label", "node", "size")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        if k < rounds:
            pairs = labelled.join(open_keys.select("key", F.col("hub.node").alias("other"), F.col("hub.size").alias("other_size"), F.col("hub.label").alias("other_label")), "key").where("label != other_label")
        else:
            left = cut(labelled.join(open_keys.select("key"), "key", "left_semi").join(sets.select("node", *_BITS), "node"))
            others = left.select("key", *[F.col(c).alias(f"other_{c}") for c in ("size", "label", *_BITS)], F.col("node").alias("other"))
            differing = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in _BITS), F.lit(0))
            allowed = (F.col("size") + F.col("other_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
            pairs = left.join(others, "key").where("node < other and label != other_label").where(differing <= allowed)
        pairs = cut(pairs.where(fits).select(*ends).distinct().join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if k < rounds:
                continue
            break
        tested = tested.union(pairs)
        links = cut(_linked(pairs, sets, similarity))
        if not links.isEmpty():
            parts = _merged(parts, links)
        tidied(spark)
    return parts


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) with new ``links`` between nodes: only the components that they touch are worked on."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = cut(parts.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("label")))
    between = links.join(known.toDF("a", "u"), "a").join(known.toDF("b", "v"), "b").select("u", "v").where("u != v").distinct()
    found = connected_components(between, "u", "v").withColumnRenamed("node", "label")
    return cut(known.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("component")))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 24, per_band: int = 6, rounds: int = 2, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, nulls last, and among rows of
    one id that with the smallest hash of its text.

    A pair whose SimHashes differ in ``max_bits`` at most is compared, any other one of similarity s with probability
    ``1 - (1 - s**per_band)**bands``; it is linked only if its exact similarity is enough. What is decided is rows, not ids: rows that share an id go or stay by their own texts.

    Defined cases: null and blank texts are one group, similar to nothing else; a text of fewer words than a shingle
    is similar to equal ones only; of rows that repeat both id and text one stays (the least by all its columns); an
    empty table stays empty. Columns keep their names and order whatever they are called.
    """
    spark = docs.sparkSession
    ship(spark)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(own.alias("id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    prints = stored(_prints(rows, kind, shingle, bands, per_band), "prints")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc")
    classes = stored(prints.groupBy("node").agg(F.min(order).alias("least"), F.first("size").alias("size"), F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys")), "classes")
    buckets = classes.select("node", "size", F.explode("keys").alias("key"))
    shared = cut(buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    buckets = stored(buckets.join(given(shared, 1_000_000), "key", "left_semi"), "buckets")
    near = _near_prints(classes, max_bits, similarity)
    wanted = cut(buckets.select("node").union(near.select("a")).union(near.select("b")).distinct())
    same = lambda a, b: (a["doc"] == b["doc"]) & a["id"].eqNullSafe(b["id"])
    owners = cut(classes.join(wanted, "node", "left_semi").select("least.id", "least.doc").distinct())
    some = given(owners)
    sets = stored(_sets(rows.join(some, same(rows, some), "left_semi"), shingle).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    parts = _components(spark, buckets, sets, similarity, rounds, near)

    known = classes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("label"))
    firsts = known.groupBy("label").agg(F.min("least").alias("first"))
    firsts = cut(known.join(firsts, "label").select("node", "first"))
    # a row that isn't the first of its group goes; of a first row that is repeated one stays
    counted = prints.groupBy("id", "doc", "node").agg(F.count("*").alias("times")).join(firsts, "node")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc"))
    marks = cut(counted.where(~is_first | (F.col("times") > 1)).select("id", "doc", is_first.alias("again")))
    for table in (prints, classes, buckets, sets):
        dropped(table)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("id"), F.xxhash64(text).alias("doc"))
    some = given(marks)
    marked = whole.join(some, same(whole, some), "left").select("row", whole["id"], whole["doc"], "again")
    kept = marked.where("again is null").select("row")
    if not marks.where("again").isEmpty():
        kept = kept.union(marked.where("again").groupBy("id", "doc").agg(F.min("row").alias("row")).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
