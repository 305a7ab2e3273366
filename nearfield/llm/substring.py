"""Substring dedup by compact windows.

Tokens are hashes of word shingles. Under one min-hash function, the sub-sequences of ``width`` tokens that share their
minimum are a compact window: the node of the Cartesian tree over the token hashes that the minimum is, cut to that
width. Only nodes of at least ``width`` tokens have any, and those are what a sliding minimum meets, so the windows of a
whole batch are found at once as the runs of equal sliding minima (neighbouring nodes with one and the same token, as in
a text that repeats a word, are one window). Each window is a row, keyed by its function and token. Rows of different
documents with one key are joined where their intervals overlap once aligned at the minimum; neighbouring overlaps are
put together and every aligned sub-sequence in them is verified.

Two sub-sequences of similarity s collide under each of the ``hashes`` functions with probability s; what takes part has
collisions under ``collisions`` of them at least. Rows of a key are compared with its first document. Sub-sequences that
this doesn't verify, under keys that have other documents too, belong to common stretches that many documents share
without being similar. They are compared, with each other and with the verified ones of these keys, without regard to
keys: by equal content, and then by the rarest tokens of each sub-sequence: two sets of sizes m and n and of Jaccard
similarity s have ``s / (1 + s) * (m + n)`` tokens in common, so the first token that they share, in the order of
rarity, has as many left in both from itself on, and those of a common stretch are not rare. Under each of these tokens
a sub-sequence is compared with the first document that has it; if it isn't similar to that one, with all others whose
bitmaps of tokens allow as many in common. So of the pairs of a token only those are not compared that are both similar
to one third, which links them. Texts that are equal as a whole are one document in all of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import connected_components, cut, dropped, executors_tidied, given, lean, ship, stored, stretches

_PLACE_BITS = 20
_MOST = 1 << _PLACE_BITS
_FILL = 1 << 15  # tokens of short texts that are worked on together: what a processor's cache holds
_BITS = ["bits0", "bits1", "bits2", "bits3"]  # a bitmap of tokens
_MAP_WORDS = 1 << 21  # of the bitmap of keys: 16 MiB, whatever the input
_SKETCH = 1 << 22  # buckets of the counts of tokens: 16 MiB
_CHUNK = 1 << 18  # bytes of texts that are hashed together
_LONG = 64  # bytes of a word from which on it is hashed by itself
_LOWER = bytes(32 if chr(c) in " \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """A hash of each run of ``shingle`` words, A-Z lower-cased; empty for a text with fewer words."""
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, p.lower().split()), np.uint64) for p in stretches((text or "").encode("utf-8", "surrogatepass"))]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, shingle):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return _mix(out)


def word_hashes(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number before each edge) of the words of ``raw``, A-Z lower-cased; ``edges`` are the places where a text
    begins, and the end."""
    n = len(raw)
    low = np.frombuffer(raw.translate(_LOWER) + bytes(8), np.uint8)
    word = low[:n] != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left = np.flatnonzero(lengths <= _LONG)
    at, rest = starts[left], lengths[left]
    while len(left):
        spare = np.maximum(8 - rest, 0).astype(np.uint64) * np.uint64(8)
        out[left] = _mix((out[left] * np.uint64(0xD6E8FEB86659FD93)) ^ (eight[at] << spare))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(low[starts[k] : ends[k]])
    return out, np.searchsorted(starts, edges)


def token_rows(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the runs of ``shingle`` words of each text; empty for null and for fewer words."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2] or b"")
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + _CHUNK, side="right")) - 1)
        raw, edges = bytes(data[offsets[k] : offsets[end]]), offsets[k : end + 1] - offsets[k]
        if len(raw) > 4 * _CHUNK:  # one long text
            words = np.concatenate([word_hashes(part, np.array([0, len(part)]))[0] for part in stretches(raw)])
            places = np.array([0, len(words)])
        else:
            words, places = word_hashes(raw, edges)
        n = max(0, len(words) - shingle + 1)
        tokens = words[:n].copy()
        for j in range(1, shingle):
            tokens = tokens * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        tokens = _mix(tokens)
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            yield tokens[a : max(a, b - shingle + 1)]
        k = end


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    n = len(x) - width + 1
    least, size = x, 1  # minima of runs of size values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


def compact_windows(tokens: np.ndarray, owners: np.ndarray, width: int, function: int) -> tuple[np.ndarray, ...]:
    """(key, first start, last start, place of the minimum) of the windows of one function; ``owners`` tells the
    document of each token, and no window crosses from one to another."""
    if len(tokens) < width:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    places = np.arange(len(tokens), dtype=np.uint64)
    salt = np.uint64((function + 1) * 0x632BE59BD9B4E019 % 2**64)
    least = sliding_minimum((_mix(tokens + salt) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places, width)
    at = (least & np.uint64(_MOST - 1)).astype(np.int64)
    change = np.ones(len(least), bool)
    change[1:] = (tokens[at[1:]] != tokens[at[:-1]]) | (owners[1 : len(least)] != owners[: len(least) - 1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least)) - 1
    # a run that begins within its document may end in sub-sequences that leave it
    last = np.minimum(last, np.searchsorted(owners, owners[first], side="right") - width)
    good = last >= first
    first, last = first[good], last[good]
    return _mix(tokens[at[first]] * np.uint64(0x9E3779B97F4A7C15) + salt), first, last, at[first]


def _blocks(batch: pa.RecordBatch, width: int, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, tokens before it, owner of each token, tokens) for parts of texts that fill a block."""
    block: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b[2]) for b in block])
        before = np.array([b[1] for b in block]) - (np.cumsum(lengths) - lengths)
        return np.array([b[0] for b in block]), before, np.repeat(np.arange(len(block)), lengths), np.concatenate([b[2] for b in block])

    for row, tokens in enumerate(token_rows(batch.column(1), shingle)):
        for at in range(0, max(1, len(tokens) - width + 1), _MOST // 2):
            part = tokens[at : at + _MOST // 2 + width - 1]
            if len(part) < width:
                continue
            if block and size + len(part) > _FILL:
                yield done()
                block, size = [], 0
            block.append((row, at, part))
            size += len(part)
    if block:
        yield done()


def _key_bitmap(docs: DataFrame, width: int, hashes: int, shingle: int) -> np.ndarray:
    """A bitmap of fixed size with the bits of all keys that more than one row of ``docs`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, owners, tokens in _blocks(batch, width, shingle):
                for f in range(hashes):
                    key, first, _, _ = compact_windows(tokens, owners, width, f)
                    own = _mix(key + rows[owners[first]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    key = key[np.unique(own, return_index=True)[1]]  # once a document
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    keys = docs.mapInArrow(lean(_packed(run)), "key bigint").groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(_MAP_WORDS - 1)).cast("int")
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    found = keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(_MAP_WORDS, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _windows(docs: DataFrame, kind: str, width: int, hashes: int, shingle: int, collisions: int, shared: Broadcast) -> DataFrame:
    """(key, id, first, last, at) of the windows whose key's bit is set in the bitmap ``shared``, cut to the starts that
    lie in such windows of ``collisions`` functions at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, before, owners, tokens in _blocks(batch, width, shingle):
                found, covered = [], np.zeros(len(tokens) + 2, np.int64)
                for f in range(hashes):
                    key, first, last, at = compact_windows(tokens, owners, width, f)
                    words = shared.value[((key >> np.uint64(6)) & np.uint64(_MAP_WORDS - 1)).astype(np.int64)].view(np.uint64)
                    some = (words >> (key & np.uint64(63))) & np.uint64(1) == 1
                    found.append((key[some], first[some], last[some], at[some]))
                    covered += np.bincount(first[some], minlength=len(covered)) - np.bincount(last[some] + 1, minlength=len(covered))
                good = np.concatenate([[0], np.cumsum(np.cumsum(covered) >= collisions)])  # good starts before a place
                for key, first, last, at in found:
                    some = good[last + 1] > good[first]
                    key, first, last, at = key[some], first[some], last[some], at[some]
                    first, last = np.searchsorted(good, good[first], side="right") - 1, np.searchsorted(good, good[last + 1], side="left") - 1
                    own = owners[first]
                    ids = batch.column(0).take(pa.array(rows[own]))
                    columns = [pa.array(key.view(np.int64)), ids, *(pa.array((x + before[own]).astype(np.int32)) for x in (first, last, at))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "first", "last", "at"])

    return docs.mapInArrow(lean(_packed(run)), f"key bigint, id {kind}, first int, last int, at int")


def _unpacked(ranges: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of a list of ranges of :func:`_ranges`."""
    both = ranges.values.to_numpy()
    return both >> 32, (both & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _ranges(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text, ranges) of the documents with wanted (id, start, end) token ranges."""
    packed = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.col("end").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    lists = cut(wanted.groupBy("id").agg(F.collect_set(packed).alias("ranges")))
    return docs.join(given(lists, 400_000, 48 << 20), "id").select("id", "text", "ranges")


@lru_cache(8)
def _powers(odd: int, n: int) -> np.ndarray:
    """The first ``n`` powers, modulo 2**64; texts of about one length share them."""
    return np.cumprod(np.full(n, odd, np.uint64))


def range_hashes(tokens: np.ndarray, starts: np.ndarray, width: int, odd: int) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of the ``width`` tokens from each of ``starts`` on."""
    power, back = (_powers(x, 1 << max(10, len(tokens).bit_length()))[: len(tokens)] for x in (odd, pow(odd, -1, 2**64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power)])
    return (total[starts + width] - total[starts]) * back[starts]


def _contents(docs: DataFrame, rows: DataFrame, left: DataFrame, kind: str, width: int, shingle: int) -> DataFrame:
    """(content, more, id, x, open): 128 bits of hashes of each sub-sequence of ``width`` tokens that begins in the starts
    of ``rows``, and whether these are starts of a row of ``left`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tokens, ranges in zip(batch.column(0), token_rows(batch.column(1), shingle), batch.column(2), strict=True):
                starts, ends = _unpacked(ranges)
                size = len(tokens) + 1
                # the ranges of rows that are left have negative ends
                wanted, opened = (np.bincount(starts[some], minlength=size) - np.bincount(np.abs(ends[some]), minlength=size) for some in (ends > 0, ends < 0))
                own = np.flatnonzero(np.cumsum(wanted) > 0)
                if not len(own):
                    continue
                held = tokens[own[0] : own[-1] + width]
                content, more = (_mix(range_hashes(x, own - own[0], width, odd)) for x, odd in ((held, 0x9E3779B97F4A7C15), (_mix(held), 0xD6E8FEB86659FD93)))
                columns = [pa.array(content.view(np.int64)), pa.array(more.view(np.int64)), pa.repeat(key, len(own)), pa.array(own.astype(np.int32)), pa.array(np.cumsum(opened)[own] > 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["content", "more", "id", "x", "open"])

    wanted = rows.select("id", F.col("first").alias("start"), (F.col("last") + 1).alias("end")).distinct()
    opened = left.select("id", F.col("first").alias("start"), (-1 - F.col("last")).alias("end")).distinct()
    return _ranges(docs, wanted.union(opened)).mapInArrow(lean(_packed(run)), f"content bigint, more bigint, id {kind}, x int, open boolean")


def _packed(run, rows: int = 1 << 16):
    """``run`` with its small batches put together."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def rare_tokens(tokens: np.ndarray, starts: np.ndarray, width: int, similarity: float, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, start, room, size) of the rarest tokens of the sub-sequences that begin at ``starts``: as many of each as a
    similar one must share one of. The order is by ``counts`` of the tokens' buckets, then by the tokens; room is the
    number of different tokens from this one on, size that of all."""
    found = [[np.zeros(0, np.int64)] for _ in range(4)]
    if not len(starts):
        return tuple(map(np.concatenate, found))
    begin = int(starts.min())
    tokens, starts = tokens[begin : int(starts.max()) + width], starts - begin
    n = len(tokens)
    often = counts[_bucket(tokens)]
    held = np.concatenate([[0], np.cumsum(often > 1)])
    starts = starts[held[starts + width] > held[starts]]
    by_rank = np.lexsort((tokens, often))
    rank = np.empty(n, np.int32)
    rank[by_rank] = np.arange(n)  # tokens that are equal are neighbours
    ranked = tokens[by_rank]
    again = np.zeros(n + 1, np.int64)  # tokens that the text has more than once
    twice = np.flatnonzero(ranked[1:] == ranked[:-1])
    again[1 + by_rank[twice]] = again[1 + by_rank[twice + 1]] = 1
    again = np.cumsum(again)
    plain = again[starts + width] == again[starts]
    most = int(np.floor(width - similarity * width + 1e-9)) + 1  # of tokens that are all different

    def put(place: np.ndarray, own: np.ndarray, wanted: np.ndarray, room: np.ndarray, size: np.ndarray) -> None:
        times = wanted.sum(axis=1)
        for into, values in zip(found, (place[wanted] + begin, np.repeat(own + begin, times), room[wanted], np.repeat(size, times)), strict=True):
            into.append(values)

    for k in range(0, len(starts), 4096):
        own = starts[k : k + 4096][plain[k : k + 4096]]
        if len(own):
            least = rank[own[:, None] + np.arange(width)]
            if most < width:
                least = np.partition(least, most - 1, axis=1)[:, :most]
            place = by_rank[np.sort(least, axis=1)]
            room = np.broadcast_to(width - np.arange(place.shape[1]), place.shape)
            put(place, own, often[place] > 1, room, np.full(len(own), width))
        own = starts[k : k + 4096][~plain[k : k + 4096]]
        if len(own):
            place = by_rank[np.sort(rank[own[:, None] + np.arange(width)], axis=1)]
            here = tokens[place]
            fresh = np.ones(here.shape, bool)
            fresh[:, 1:] = here[:, 1:] != here[:, :-1]
            nth = np.cumsum(fresh, axis=1)  # number of different tokens so far
            room = nth[:, -1:] - nth + 1
            put(place, own, fresh & (room >= similarity * nth[:, -1:] - 1e-9) & (often[place] > 1), room, nth[:, -1])
    return tuple(map(np.concatenate, found))


def token_bitmaps(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of words for each range, whose bits tell where its tokens fall."""
    lengths = ends - starts
    row = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
    bits = np.zeros((len(starts), 64 * len(_BITS)), np.uint8)
    bits[row, (tokens[place] >> np.uint64(20)).astype(np.int64) % bits.shape[1]] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(42)).astype(np.int64) % _SKETCH


def _rare_rows(docs: DataFrame, starts: DataFrame, kind: str, width: int, similarity: float, shingle: int) -> DataFrame:
    """(token, id, place, x, y, open, room, size, bitmap) of the sub-sequences in ``starts`` (id, x, open) that have
    one place among their rarest, as ranges of starts: the largest room and the least size of each, and a bitmap of all
    its tokens."""
    spark = docs.sparkSession
    texts = _ranges(docs, starts.select("id", F.col("x").alias("start"), F.col("open").cast("int").alias("end")))

    def own(ranges: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        x, opened = _unpacked(ranges)
        order = np.argsort(x, kind="stable")
        return x[order], opened[order] > 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, opens = np.zeros((2, _SKETCH), np.int32)
        for batch in batches:
            for tokens, ranges in zip(token_rows(batch.column(1), shingle), batch.column(2), strict=True):
                x, opened = own(ranges)
                for into, some in ((total, x), (opens, x[opened])):
                    if not len(some):
                        continue
                    held = np.bincount(some, minlength=len(tokens) + 1) - np.bincount(some + width, minlength=len(tokens) + 1)
                    np.add.at(into, _bucket(np.unique(tokens[np.cumsum(held[:-1]) > 0])), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(opens[some] > 0)], names=["bucket", "c", "open"])

    table = texts.mapInArrow(lean(count), "bucket int, c int, open boolean").groupBy("bucket").agg(F.least(F.sum("c"), F.lit(2**31 - 1)).cast("int").alias("c"), F.max("open").alias("open")).where("c > 1 and open").select("bucket", "c").toArrow()
    counts = np.ones(_SKETCH, np.int32)
    counts[table.column("bucket").to_numpy()] = table.column("c").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tokens, ranges in zip(batch.column(0), token_rows(batch.column(1), shingle), batch.column(2), strict=True):
                x, opened = own(ranges)
                place, start, room, size = rare_tokens(tokens, x, width, similarity, shared.value)
                if not len(place):
                    continue
                far = room < 2 * similarity / (1 + similarity) * size - 1e-9  # of use with smaller sets only
                order = np.lexsort((start, far, place))
                place, start, room, size, far = (v[order] for v in (place, start, room, size, far))
                # runs of starts that have one place among their rarest
                begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (far[1:] != far[:-1]) | (start[1:] > start[:-1] + 1)]))
                first, last = start[begins], start[np.append(begins[1:], len(place)) - 1]
                single = np.maximum.reduceat(opened[np.searchsorted(x, start)], begins)
                ints = (place[begins], first, last, np.maximum.reduceat(room, begins), np.minimum.reduceat(size, begins))
                at, x0, y0, most, least = (pa.array(v.astype(np.int32)) for v in ints)
                bits = map(pa.array, np.ascontiguousarray(token_bitmaps(tokens, first, last + width).T))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[place[begins]].view(np.int64)), pa.repeat(key, len(begins)), at, x0, y0, pa.array(single), most, least, *bits], names=["token", "id", "place", "x", "y", "open", "room", "size", *_BITS])

    schema = f"token bigint, id {kind}, place int, x int, y int, open boolean, room int, size int" + "".join(f", {b} bigint" for b in _BITS)
    return stored(texts.mapInArrow(lean(_packed(rare)), schema), "rare-tokens")


def _rare_pairs(rows: DataFrame, others: DataFrame, width: int, similarity: float, skip: bool = False) -> DataFrame:
    """(id, other, shift, x, y) of ``rows`` and ``others`` (columns o_...) of one token, aligned at that token, without
    pairs that can't be similar or of which neither is open: the common tokens are at most those from the first common
    one on, and at most those whose bits both have. ``skip`` leaves out those of one label that are both covered."""
    a, o = F.col, lambda c: F.col(f"o_{c}")
    needed = (a("size") + o("size")) * (similarity / (1 + similarity)) - 1e-6
    pairs = rows.join(others, a("token") == o("token")).where((a("id") != o("id")) & (a("open") | o("open")))
    if skip:
        pairs = pairs.where((a("label") != o("label")) | ~(a("covered") & o("covered")))
    shift = a("place") - o("place")
    x, y = F.greatest(a("x"), o("x") + shift), F.least(a("y"), o("y") + shift)
    pairs = pairs.where((x <= y) & (F.least("room", "o_room") >= needed))
    for p, q in ((a, o), (o, a)):  # the tokens of p's range without those that q's bitmap rules out
        out = sum((F.bit_count(p(b).bitwiseAND(F.bitwise_not(q(b)))) for b in _BITS), F.lit(0))
        pairs = pairs.where(p("y") - p("x") + width - out >= needed)
    return pairs.select("id", o("id").alias("other"), shift.alias("shift"), x.alias("x"), y.alias("y"))


def _spans(sides: DataFrame) -> DataFrame:
    """(id, start, end) of passages without those that lie within another one of their document."""
    order = Window.partitionBy("id").orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sides.select("id", "start", "end").distinct().withColumn("before", before).where("before is null or end > before").drop("before")


def _fewer(df: DataFrame) -> DataFrame:
    """``df``, whose partitions are small, in an eighth of them: each is a task, and a file once it is written."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // 8))


def _sides(found: DataFrame, width: int) -> DataFrame:
    """(i, o, s, from, to): passages seen from either side, as aligned starts, in a table of their own."""
    sides = found.select("id", "other", (F.col("start") - F.col("other_start")).alias("s"), "start", "end")
    sides = sides.union(found.select("other", "id", (F.col("other_start") - F.col("start")).alias("s"), "other_start", "other_end"))
    return stored(_fewer(sides.withColumn("end", F.col("end") - width).toDF("i", "o", "s", "from", "to")), "sides")


def _unknown(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The aligned starts (id, other, shift, x, y) without those that lie in a passage of ``sides``."""
    inside = (F.col("id") == F.col("i")) & (F.col("other") == F.col("o")) & (F.col("shift") == F.col("s")) & (F.col("x") >= F.col("from")) & (F.col("y") <= F.col("to"))
    return pairs.distinct().join(sides, inside, "left_anti")


def _rare(docs: DataFrame, starts: DataFrame, found: DataFrame, kind: str, width: int, similarity: float, shingle: int) -> DataFrame:
    """The verified passages of the sub-sequences in ``starts`` (id, x, open), one of the two at least open: with the
    first ones that share one of their rarest tokens, and what isn't similar to these with all others. Passages that are
    ``found`` already are not verified again, and of documents that passages link already only sub-sequences that are
    in none are compared once more: neither classes nor spans can gain by the rest."""
    spark = docs.sparkSession
    rows = _rare_rows(docs, starts, kind, width, similarity, shingle)
    names = ["id", "place", "x", "y", "open", "room", "size", *_BITS]
    hubs = rows.groupBy("token").agg(F.min(F.struct(*names)).alias("hub"), F.max("id").alias("most")).where("hub.id != most")
    hubs = cut(hubs.select(F.col("token").alias("o_token"), *[F.col(f"hub.{c}").alias(f"o_{c}") for c in names]))
    before = _sides(found, width)
    first = _compared(docs, cut(_unknown(_rare_pairs(rows, hubs, width, similarity), before)), kind, width, shingle, similarity)
    after = _sides(first, width)
    sides = before.union(after)
    executors_tidied(spark)
    # rows whose sub-sequences are all similar to the hub's are known; of the others some lie in passages
    labels = cut(connected_components(sides.where("i > o"), "i", "o").toDF("i", "label"))
    cover = cut(_spans(sides.select(F.col("i").alias("id"), F.col("from").alias("start"), (F.col("to") + width).alias("end"))).select(F.col("id").alias("i"), F.col("start").alias("from"), (F.col("end") - width).alias("to")))
    shift = F.col("place") - F.col("o_place")
    of = rows.join(hubs.select("o_token", "o_id", "o_place", "o_x"), F.col("token") == F.col("o_token"))
    of = of.where((F.col("id") != F.col("o_id")) | (F.col("place") != F.col("o_place")) | (F.col("x") != F.col("o_x"))).withColumn("shift", shift)
    out = lambda c: F.col(c).outer()
    within = (F.col("i") == out("id")) & (F.col("from") <= out("x")) & (F.col("to") >= out("y"))
    aligned = within & (F.col("o") == out("o_id")) & (F.col("s") == out("shift"))
    of = of.withColumn("known", sides.where(aligned).exists()).select("token", *names, "known").withColumn("covered", cover.where(within).exists())
    of = of.join(labels, F.col("id") == F.col("i"), "left").withColumn("label", F.coalesce("label", "id")).drop("i")
    told = stored(of, "told")
    left, done = told.where("not known").drop("known"), told.where("known").drop("known")
    side = lambda df: df.toDF(*[f"o_{c}" for c in df.columns])
    more = _rare_pairs(left, side(left), width, similarity, True).where("id > other").union(_rare_pairs(left, side(done), width, similarity, True))
    more = cut(_unknown(more, sides))
    for table in (rows, told, before, after):
        dropped(table)
    return first if more.isEmpty() else first.union(_compared(docs, more, kind, width, shingle, similarity))


def _islands(pairs: DataFrame, width: int) -> DataFrame:
    """(id, other, start, end, other_start, other_end) of aligned starts x to y, put together where they are next to
    each other."""
    order = Window.partitionBy("id", "other", "shift").orderBy("x", "y")
    before = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = pairs.withColumn("begins", F.when(before.isNull() | (F.col("x") > before + 1), 1).otherwise(0))
    joined = joined.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    regions = joined.groupBy("id", "other", "shift", "island").agg(F.min("x").alias("start"), (F.max("y") + width).alias("end"))
    return regions.select("id", "start", "end", "other", (F.col("start") - F.col("shift")).alias("other_start"), (F.col("end") - F.col("shift")).alias("other_end"))


def _slices(docs: DataFrame, wanted: DataFrame, kind: str, shingle: int) -> DataFrame:
    """(id, start, end, shingles) of the wanted token ranges, 32 bits of each; as often as an id is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, sets = [], [], [], []
            for key, tokens, ranges in zip(batch.column(0), token_rows(batch.column(1), shingle), batch.column(2), strict=True):
                tokens = (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for start, end in zip(*map(np.ndarray.tolist, _unpacked(ranges)), strict=True):
                    ids.append(key.as_py())
                    starts.append(start)
                    ends.append(end)
                    sets.append(tokens[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["id", "start", "end", "shingles"])

    return _ranges(docs, wanted).mapInArrow(lean(run), f"id {kind}, start int, end int, shingles array<int>")


def similar_starts(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Which aligned sub-sequences of ``width`` tokens of two equally long ranges are similar: as sets by Jaccard, or
    by as many tokens that are equal in place.

    Tokens that both ranges have once are counted for all starts together; only sub-sequences that hold a repeated
    token are compared one by one.
    """
    same = np.concatenate([[0], np.cumsum(a == b)])
    ok = (same[width:] - same[:-width]) * (1 + similarity) >= 2 * similarity * width
    if ok.all():
        return ok
    n = len(a)

    def enough(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By start: so many pairs of places p and q lie in a sub-sequence that begins there."""
        near = np.abs(p - q) < width
        least, most = np.minimum(p, q)[near], np.maximum(p, q)[near]
        common = np.bincount(np.maximum(most - width + 1, 0), minlength=n + 1) - np.bincount(least + 1, minlength=n + 1)
        return np.cumsum(common)[: len(ok)] * (1 + similarity) >= 2 * similarity * width - 1e-9

    order = np.argsort(np.concatenate([a, b]), kind="stable")
    ranked = np.concatenate([a, b])[order]
    twin = np.flatnonzero(ranked[1:] == ranked[:-1])
    p, q = order[twin], order[twin + 1] - n
    if (p < n).all() and (q >= 0).all():  # no token is repeated
        return ok | enough(p, q)
    (x, first, times), (y, other, others) = np.unique(a, return_index=True, return_counts=True), np.unique(b, return_index=True, return_counts=True)
    both, k, m = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return ok
    twice = np.union1d(x[times > 1], y[others > 1])
    held = np.concatenate([[0], np.cumsum(np.isin(a, twice) | np.isin(b, twice))])
    plain = held[width:] == held[:-width]
    ok |= plain & enough(first[k], other[m])
    for k in np.flatnonzero(~ok & ~plain):
        own, theirs = set(a[k : k + width].tolist()), set(b[k : k + width].tolist())
        shared = len(own & theirs)
        ok[k] = shared >= similarity * (len(own) + len(theirs) - shared) - 1e-9
    return ok


def _in_place(a: pa.ListArray, b: pa.ListArray, width: int, similarity: float) -> np.ndarray:
    """For which rows of equally long lists all sub-sequences have enough tokens that are equal in place."""
    same = np.concatenate([[0], np.cumsum(a.flatten().to_numpy() == b.flatten().to_numpy())])
    after = np.cumsum(a.value_lengths().to_numpy().astype(np.int64))
    ok = (same[width:] - same[:-width]) * (1 + similarity) >= 2 * similarity * width
    bad = np.concatenate([[0], np.cumsum(~ok)])  # starts that aren't similar before a place
    first = np.concatenate([[0], after[:-1]])
    return bad[after - width + 1] == bad[first]


def _verified(both: DataFrame, kind: str, width: int, similarity: float) -> DataFrame:
    """The parts of the regions whose every sub-sequence of ``width`` tokens is similar to the aligned one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            whole = _in_place(batch.column("a"), batch.column("b"), width, similarity)
            for every, key, start, other, other_start, a, b in zip(whole.tolist(), *(batch.column(k) for k in ("id", "start", "other", "other_start", "a", "b")), strict=True):
                if every:
                    f, o, n = start.as_py(), other_start.as_py(), len(a)
                    rows.append((key.as_py(), f, f + n, other.as_py(), o, o + n))
                    continue
                ok = similar_starts(a.values.to_numpy(), b.values.to_numpy(), width, similarity)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
                rows += [(key.as_py(), start.as_py() + f, start.as_py() + e - 1 + width, other.as_py(), other_start.as_py() + f, other_start.as_py() + e - 1 + width) for f, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            own = batch.column("id").type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (own, pa.int32(), pa.int32()) * 2, strict=True)], names=["id", "start", "end", "other", "other_start", "other_end"])

    return both.select("id", "start", "other", "other_start", "a", "b").mapInArrow(lean(run), f"id {kind}, start int, end int, other {kind}, other_start int, other_end int")


def _compared(docs: DataFrame, pairs: DataFrame, kind: str, width: int, shingle: int, similarity: float) -> DataFrame:
    """The verified passages of aligned starts (id, other, shift, x, y)."""
    regions = cut(_islands(pairs, width))
    theirs = regions.select(F.col("other").alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))
    sets = stored(_slices(docs, regions.select("id", "start", "end").union(theirs).distinct(), kind, shingle), "passages")
    both = regions.join(sets.withColumnRenamed("shingles", "a"), ["id", "start", "end"])
    both = both.join(sets.select(F.col("id").alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.col("shingles").alias("b")), ["other", "other_start", "other_end"])
    good = cut(_verified(both, kind, width, similarity))
    dropped(sets)
    return good


def _copies(docs: DataFrame, kind: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """The passages of documents whose whole text is that of one with a smaller id, and the other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([sum(len(p.split()) for p in stretches(text.as_py().encode("utf-8", "surrogatepass"))) for text in batch.column(1)], pa.int32())
            zero = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), zero, n, batch.column(2), zero, n], names=["id", "start", "end", "other", "other_start", "other_end"])

    text = F.col("text")
    prints = docs.withColumns({"a": F.xxhash64(text), "b": F.xxhash64(F.lit(1), text), "c": F.octet_length(text)})
    firsts = prints.where("text is not null").groupBy("a", "b", "c").agg(F.min("id").alias("other"), F.max("id").alias("most")).where("other != most").drop("most")
    keys = ["a", "b", "c"]
    classes = cut(firsts)
    firsts = given(classes)
    same = prints.join(firsts, keys)
    copies = same.where("id != other").select("id", "text", "other")
    whole = cut(copies.mapInArrow(lean(run), f"id {kind}, start int, end int, other {kind}, other_start int, other_end int").where(F.col("end") >= min_words).distinct())
    rest = prints.join(firsts, keys, "left").where("other is null or id = other").select("id", "text")
    return whole, stored(rest, "texts") if firsts is classes else rest


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, shingle: int = 5, hashes: int = 4, similarity: float = 0.8, rounds: int = 1, collisions: int = 2) -> DataFrame:
    """(id, start, end, other, other_start, other_end): word ranges of passages that two documents share, computed.

    A passage of ``min_words`` equal words is always found; sub-sequences of similarity s meet with the
    probability that ``collisions`` of ``hashes`` draws of probability s succeed (0.973 at 0.8). What meets and isn't
    verified in ``rounds`` rounds is compared by content and by rare tokens with all that has its keys, so of what meets
    no sub-sequence is left without a passage if it is similar to any other. Of documents with equal texts the first one
    is compared, and each other one shares its whole text with it.
    """
    spark = docs.sparkSession
    ship(spark)
    width = min_words - shingle + 1
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    copies, docs = _copies(docs, kind, min_words)
    shared = spark.sparkContext.broadcast(_key_bitmap(docs, width, hashes, shingle))
    executors_tidied(spark)
    windows = rows = stored(_windows(docs, kind, width, hashes, shingle, collisions, shared), "windows")
    out = spark.createDataFrame([], f"id {kind}, start int, end int, other {kind}, other_start int, other_end int")
    met = []
    for _ in range(rounds):
        row = F.struct("id", "first", "last", "at")
        hubs = rows.groupBy("key").agg(F.min(row).alias("hub"), F.max("id").alias("most")).where("hub.id != most").select("key", "hub")
        pairs = rows.join(hubs, "key").where("id != hub.id").withColumn("shift", F.col("at") - F.col("hub.at"))
        pairs = pairs.withColumns({"x": F.greatest("first", F.col("hub.first") + F.col("shift")), "y": F.least("last", F.col("hub.last") + F.col("shift")), "other": F.col("hub.id")})
        pairs = stored(pairs.select("key", "id", "first", "last", "at", "other", "shift", "x", "y"), "pairs")
        good = _compared(docs, pairs.where("x <= y").select("id", "other", "shift", "x", "y"), kind, width, shingle, similarity)
        out = out.union(good)
        # a row goes if all of its own sub-sequences are in a passage verified at its own alignment
        own = good.select(F.col("id").alias("i"), F.col("other").alias("o"), (F.col("start") - F.col("other_start")).alias("s"), F.col("start").alias("from"), (F.col("end") - width).alias("to"))
        inside = (F.col("id") == F.col("i")) & (F.col("other") == F.col("o")) & (F.col("shift") == F.col("s")) & (F.col("first") >= F.col("from")) & (F.col("last") <= F.col("to"))
        rows = cut(pairs.join(own, inside, "left_anti").select("key", "id", "first", "last", "at"))
        met.append(pairs)
    dropped(windows)
    executors_tidied(spark)
    # keys with documents besides the hub of which one isn't verified; all rows that the hub was compared with
    doubtful = met[0].join(given(cut(rows.select("key").distinct()), 1_000_000), "key", "left_semi") if met else rows
    doubtful = cut(doubtful.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("key"))
    members = lambda df: df.join(given(doubtful, 1_000_000), "key", "left_semi")
    contents = stored(_contents(docs, members(met[0] if met else rows), members(rows), kind, width, shingle), "contents")
    for pairs in met:
        dropped(pairs)
    firsts = cut(contents.groupBy("content", "more").agg(F.min(F.struct("id", "x")).alias("hub"), F.max("id").alias("most"), F.max("open").alias("open")))
    equal = contents.drop("open").join(firsts.where("hub.id != most and open"), ["content", "more"]).where("id != hub.id").select("id", F.col("hub.id").alias("other"), (F.col("x") - F.col("hub.x")).alias("shift"), "x", F.col("x").alias("y"))
    out = out.union(cut(_islands(equal, width)))
    dropped(contents)
    executors_tidied(spark)
    starts = firsts.select("hub.id", "hub.x", "open")
    out = out.union(_rare(docs, starts, out, kind, width, similarity, shingle))
    words = {c: F.col(c) + (shingle - 1) for c in ("end", "other_end")}
    return out.withColumns(words).union(copies)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document that shares a passage with another: id, class_id, n_links, n_words, spans.

    class_id is the smallest id reachable over shared passages, n_links the number of documents that it was compared
    with and found to share one, spans its own word ranges, put together where they overlap, n_words the words in
    them. Documents without a shared passage have no row.

    Defined cases: null texts and texts of fewer words than a passage share nothing; rows without an id are left
    out; rows that repeat an id are one document; an empty table gives no rows; other columns are not read.
    """
    found = cut(_fewer(passages(docs, id_col, text_col, **options)))
    sides = found.select("id", "start", "end", "other").union(found.select("other", "other_start", "other_end", "id"))
    spans = sides.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"), F.size(F.collect_set("other")).cast("bigint").alias("n_links"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    put = F.aggregate(
        "s",
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    parts = connected_components(found, "id", "other").select(F.col("node").alias("id"), F.col("component").alias("class_id"))
    rows = spans.withColumn("spans", put).join(parts, "id")
    return rows.select(F.col("id").alias(id_col), "class_id", "n_links", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]).alias("n_words"), "spans")
