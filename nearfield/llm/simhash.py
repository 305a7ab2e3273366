"""SimHash near-dedup: fingerprints of word shingles, linked under a Hamming bound by pigeonring filtering.

A pair within ``max_bits`` of each other has, by the pigeonring principle, a segment from which every chain of
consecutive segments (around the ring) stays within its proportional budget: the first ``l`` segments of the
chain differ in at most ``floor(l * max_bits / segments)`` bits. With more segments than bits the first segment of
that chain is equal, and the second differs in at most one bit. So candidates are found by an equi-join on the
first two segments of the chain, one side with one bit of the second segment flipped; the longer chains prune
what is left before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import connected_components, cut, lean, ship

_BITS = 64
_BLOCK = 1 << 16
_HOT = 2000  # a class with more than this part of the rows is hot, so there are fewer than this many


def of_hashes(blocks: Iterable[Sequence[int] | np.ndarray]) -> int:
    """The fingerprint of unsigned 64-bit hashes: each bit that over half of them have."""
    total, count = np.zeros(_BITS, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(np.asarray(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for n in range(0, len(bits), 255):  # a byte holds the count of 255 rows
            total += np.add.reduce(bits[n : n + 255], axis=0, dtype=np.uint8)
        count += len(bits)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    blocks = ([digest(joined[i:j], seed) for i, j in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)] for k in range(0, len(starts), _BLOCK))
    return of_hashes(blocks)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint) for each row of ``docs``; the fingerprint is the signed view of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fingerprint"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, fingerprint bigint")


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    width, more = divmod(_BITS, count)
    out, at = [], 0
    for k in range(count):
        out.append((at, width + (k < more)))
        at += out[-1][1]
    return out


def _part(value, segment: tuple[int, int]):
    return F.shiftrightunsigned(value, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _cleared(own, masks):
    """``own`` with each bit of ``masks`` that it has cleared, one at a time."""
    return F.transform(F.filter(masks, lambda m: own.bitwiseAND(m) != 0), lambda m: own.bitwiseXOR(m))


def links(prints: DataFrame, max_bits: int = 4, segments: int = 5) -> DataFrame:
    """(a, b, bits) for every pair of different values in ``prints.fingerprint`` that differ in at most ``max_bits``.

    ``prints`` holds each fingerprint once. Each pair comes once, a < b. ``segments`` must be over ``max_bits``.
    """
    if segments <= max_bits or segments < 2:
        raise ValueError("segments must be more than max_bits, and two at least")
    cuts = _segments(segments)
    budget = [length * max_bits // segments for length in range(1, segments + 1)]
    if budget[1] > 1:
        raise ValueError("two segments of a chain must be allowed one differing bit at most")
    value = F.col("fingerprint")

    def key(start: int):
        """The first two segments of the chain that begins at start, and start itself."""
        first, second = cuts[start], cuts[(start + 1) % segments]
        return F.shiftleft(F.shiftleft(_part(value, first), second[1]).bitwiseOR(_part(value, second)), 4).bitwiseOR(F.lit(start).cast("bigint"))

    index = prints.select(value.alias("b"), F.explode(F.array(*[key(s) for s in range(segments)])).alias("key"))
    exact = prints.select(value.alias("a"), F.explode(F.array(*[key(s) for s in range(segments)])).alias("key"), F.lit(False).alias("flipped"))
    probes = exact
    if budget[1] == 1:
        flips = []
        for start in range(segments):
            width = cuts[(start + 1) % segments][1]
            # the one of the pair with the bit set clears it, so a pair comes from one side only
            masks = F.array(*[F.lit(1 << (4 + bit)).cast("bigint") for bit in range(width)])
            flips.append(_cleared(key(start), masks))
        probes = exact.union(prints.select(value.alias("a"), F.explode(F.concat(*flips)).alias("key"), F.lit(True).alias("flipped")))
    pairs = probes.join(index, "key").where("flipped or a < b").where("a != b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    start = F.col("key").bitwiseAND(F.lit(15))
    fits = F.lit(False)
    for s in range(segments):
        counts = [F.bit_count(_part(differing, cuts[(s + k) % segments])) for k in range(segments)]
        within = [reduce(lambda x, y: x + y, counts[: k + 1]) <= budget[k] for k in range(1, segments)]
        fits = fits | ((start == s) & reduce(lambda x, y: x & y, within))
    bits = F.bit_count(differing)
    return (
        pairs.where(fits)  # chains of two and more segments
        .where(bits <= max_bits)  # the full check
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bits.alias("bits"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, segments: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest id reachable over links, its own included; n_links counts the other fingerprints
    that this one links to. Rows with equal fingerprints are one class: only classes are joined, so a class of any
    size costs one row. What was found goes back to the rows of large classes by a broadcast of those classes, whose
    number is bounded, and to all others by a join on the fingerprint.

    Defined cases: null, empty and blank texts have fingerprint zero and link like any other; ids that are null take
    part but are never a component_id (which is null if a component has null ids only); repeated rows stay, each
    with the same result; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col, shingle))
    classes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("times")))
    found = cut(links(classes, max_bits, segments))
    ends = found.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    parts = connected_components(found).select(F.col("node").alias("fingerprint"), "component")
    linked = classes.join(parts, "fingerprint").join(ends, "fingerprint")
    firsts = linked.groupBy("component").agg(F.min("least").alias("first"))
    linked = linked.join(firsts, "component").select("fingerprint", "first", "n_links")
    known = cut(classes.join(linked, "fingerprint", "left").select("fingerprint", "times", F.coalesce("first", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    total = known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col("times") * _HOT > total).drop("times"))
    rest = prints.join(hot, "fingerprint", "left_anti").join(known.drop("times"), "fingerprint")
    return prints.join(hot, "fingerprint").unionByName(rest).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
        "n_links",
    )
