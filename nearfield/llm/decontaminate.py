"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanning each text once.

The automaton's letters are words: each distinct word of the items gets one code point, every other word of a text
becomes U+0000, so a text is one short string and a step of the automaton is a word. Normalising maps bytes one to
one, so word places map back to the original offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import cut, give_back, lean, ship


def _letter(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 32
    return byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20


_FOLD = bytes(_letter(b) for b in range(256))
_PLACES = re.compile(rb"[^ ]+")
_SURROGATES = range(0xD800, 0xE000)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and anything outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(text: str | None, length: int) -> set[bytes]:
    """Every run of ``length`` words of an item; the whole item if it has fewer; none if it has no word."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[k : k + length]) for k in range(max(1, len(words) - length + 1))}


class Scanner:
    """The automaton of some windows with the items that hold them."""

    def __init__(self, windows: list[tuple[bytes, str | None]]):
        self.letters: dict[bytes, str] = {}
        found: dict[str, tuple[int, set[str | None]]] = {}
        for window, item in windows:
            words = window.split(b" ")
            key = "".join(map(self._letter, words))
            found.setdefault(key, (len(words), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key, value)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def _letter(self, word: bytes) -> str:
        known = self.letters.get(word)
        if known is None:
            code = len(self.letters) + 1
            known = self.letters[word] = chr(code if code < _SURROGATES.start else code + len(_SURROGATES))
        return known

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Merged [first, after last) word places that lie in a window's occurrence, and the items."""
        spans: list[list[int]] = []
        items: set[str | None] = set()
        if self.empty:
            return spans, items
        get = self.letters.get
        for last, (length, owners) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            first = last - length + 1
            while spans and first < spans[-1][0]:  # a longer window that ends later can begin earlier
                first = min(first, spans.pop()[0])
            if spans and first <= spans[-1][1]:
                spans[-1][1] = last + 1
            else:
                spans.append([first, last + 1])
            items |= owners
        return spans, items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, after in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], after)
        else:
            out.append([first, after])
    return out


def char_spans(text: str, spans: list[list[int]]) -> list[dict[str, int]]:
    """Word spans as character offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    wanted = iter(spans)
    out, now, at, chars = [], next(wanted, None), 0, 0
    for k, place in enumerate(_PLACES.finditer(raw.translate(_FOLD))):
        if now is None:
            break
        if k == now[0]:
            chars += len(raw[at : place.start()].decode("utf-8", "surrogatepass"))
            at, begin = place.start(), chars
        if k == now[1] - 1:
            chars += len(raw[at : place.end()].decode("utf-8", "surrogatepass"))
            at = place.end()
            out.append({"start": begin, "end": chars})
            now = next(wanted, None)
    return out


_scanners: dict[int, tuple[object, Scanner]] = {}


def _scanner(windows: Broadcast, most: int = 1) -> Scanner:
    """The automaton of a broadcast, built once in each worker process, which keeps ``most`` and one more."""
    key = id(windows.value)  # the worker keeps one value per broadcast
    if key not in _scanners:
        if len(_scanners) > most:
            _scanners.clear()
        _scanners[key] = windows.value, Scanner(windows.value)
    return _scanners[key][1]


_SPANS = "array<struct<start:bigint,end:bigint>>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, shard_windows: int = 100_000, shard_bytes: int = 64_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted strings), spans (character offsets of the hits).

    The windows of ``benchmark`` are counted first and dealt into as many shards as keep each within
    ``shard_windows`` (window, item) pairs and ``shard_bytes`` bytes; each shard is one broadcast automaton and the
    shards are applied one after another within one stage, so texts are never shuffled and no broadcast grows.

    Defined cases: a null text has no words and no hit; an item without words has no window; items whose id is null
    hit words but are not listed; repeated documents and items each count as they are, items once a document; empty
    tables give no rows, or rows without hits; other columns are not read.
    """
    shared = _shards(docs.sparkSession, benchmark, item_col, item_text_col, length, shard_windows, shard_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    nothing = [F.array().cast(_SPANS).alias("places"), F.array().cast("array<string>").alias("items")]
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *nothing)
    for windows in shared[:-1]:
        state = state.mapInArrow(lean(_pass_on(windows)), f"id {kind}, text string, places {_SPANS}, items array<string>")
    state = state.mapInArrow(lean(_finish(shared[-1])), f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans {_SPANS}")
    return state.withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, shard_windows: int = 100_000, shard_bytes: int = 64_000_000) -> Column:
    """Whether the text of a row of ``docs`` holds a window of an item; false for null texts. See :func:`scan`."""
    held = F.lit(False)
    shared = _shards(docs.sparkSession, benchmark, item_col, item_text_col, length, shard_windows, shard_bytes)
    for windows in shared:
        held = held | _holds(windows, len(shared))(F.col(text_col).cast("string"))
    return held


def _holds(shared: Broadcast, shards: int):
    """Spark evaluates the functions of all shards batch by batch in one worker, so it keeps all their automata."""

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        scanner = _scanner(shared, shards)
        held = pa.array([bool(scanner.scan(words_of(x.as_py()))[0]) for x in texts], pa.bool_())
        give_back()
        return held

    return holds


def _shards(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, length: int, most_windows: int, most_bytes: int) -> list[Broadcast]:
    """The (window, item) pairs of ``benchmark``, as broadcasts that are each within the limits."""
    ship(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                for window in item_windows(text.as_py(), length):
                    ids.append(item.as_py())
                    windows.append(window)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], names=["item", "window"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = cut(items.mapInArrow(split, "item string, window binary").distinct())
    rows, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    shards = max(1, -(-rows // most_windows), -(-size // most_bytes))
    out = []
    for shard in range(shards):
        part = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == shard)
        out.append(spark.sparkContext.broadcast([(bytes(r["window"]), r["item"]) for r in part.collect()]))
    return out


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(shared: Broadcast, batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, list[list[int]], list[str]]]:
    """Text, number of words, word spans and items of each row, with what earlier shards have found."""
    scanner = _scanner(shared)
    for text, places, names in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
        whole = text.as_py()
        words = words_of(whole)
        spans, items = scanner.scan(words)
        items.discard(None)
        if len(places):
            spans = merged([[s["start"], s["end"]] for s in places.as_py()] + spans)
        if len(names):
            items |= set(names.as_py())
        yield whole, len(words), spans, sorted(items, key=str.encode)


def _objects(spans: list[list[int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def _pass_on(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_objects(spans), items) for _, _, spans, items in _scanned(shared, batch)]
            places, names = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, _ARROW_SPANS), pa.array(names, pa.list_(pa.string()))], names=["id", "text", "places", "items"])

    return run


def _finish(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits, names, places = [], [], [], []
            for text, n_words, spans, items in _scanned(shared, batch):
                counts.append(n_words)
                hits.append(sum(b - a for a, b in spans))
                names.append(items)
                places.append(char_spans(text, spans) if spans else [])
            columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(places, _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_hit", "items", "spans"])

    return run
