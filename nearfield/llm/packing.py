"""Packing: best-fit decreasing with a segment tree over remaining capacities.

Each task packs its own rows: they are tokenised in blocks, a document longer than a window is first cut into full
windows, and the pieces of a block go, longest first, to the tightest open window. Windows that stay open are carried
from block to block; what is open at the end (or when too much is open) is topped up by cutting the pieces of the
emptiest windows, and the one window that is left is cut into sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import lean, ship, stretches

_MARKS = (b".", b",", b"!", b"?", b";", b":")

Piece = tuple[int, int, bytes]  # place of its document, ids before it, its ids as little-endian unsigned 32-bit


class CapacityTree:
    """How many open windows there are of each remaining capacity; the tightest that fits is found in log steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int = 1) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of an open window that is at least ``need``; -1 if there is none."""
        counts, node = self.counts, need + self.leaves
        if counts[node]:
            return need
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not counts[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1


class Packer:
    """Windows of ``window`` tokens; ``emit`` gets each finished sequence as a list of pieces."""

    def __init__(self, window: int, slack: int, most_open: int):
        self.window, self.slack, self.most_open = window, slack, most_open
        self.tree = CapacityTree(window)
        self.open: dict[int, list[list[Piece]]] = {}  # by remaining capacity
        self.n_open = 0
        self.done: list[list[Piece]] = []

    def _put(self, pieces: list[Piece], room: int) -> None:
        if room == 0:
            self.done.append(pieces)
            return
        self.open.setdefault(room, []).append(pieces)
        self.tree.add(room)
        self.n_open += 1

    def _take(self, room: int) -> list[Piece]:
        self.tree.add(room, -1)
        self.n_open -= 1
        return self.open[room].pop()

    def pack(self, pieces: list[Piece]) -> None:
        """Places a block of pieces, longest first; closes what is full but for the slack."""
        for piece in sorted(pieces, key=lambda p: -len(p[2])):
            need = len(piece[2]) // 4
            room = self.tree.tightest(need)
            if room < 0:
                self._put([piece], self.window - need)
            else:
                self._put([*self._take(room), piece], room - need)
        for room in range(1, self.slack + 1):
            while self.open.get(room):
                self.done.append(self._take(room))
        if self.n_open > self.most_open:
            self.top_up()

    def top_up(self) -> None:
        """Fills the fullest open windows with pieces, cut where needed, of the emptiest; one window at most stays open."""
        windows = [(room, w) for room in sorted(self.open) for w in self.open[room]]
        for room in list(self.open):
            while self.open[room]:
                self._take(room)
        k, last = 0, len(windows) - 1
        while k < last:
            room, pieces = windows[k]
            while room and k < last:
                rest, giver = windows[last]
                doc, start, ids = giver.pop()
                part = ids[: 4 * room]
                pieces.append((doc, start, part))
                room -= len(part) // 4
                if len(part) < len(ids):
                    giver.append((doc, start + len(part) // 4, ids[len(part) :]))
                windows[last] = rest + len(part) // 4, giver
                if not giver:
                    last -= 1
            windows[k] = room, pieces
            if room == 0:
                self.done.append(pieces)
                k += 1
        if k == last:
            self._put(windows[k][1], windows[k][0])

    def finish(self) -> None:
        """Closes everything: tops up, then cuts the window that is left into lengths that are powers of two."""
        self.top_up()
        for room in list(self.open):
            while self.open[room]:
                pieces = self._take(room)
                left = self.window - room
                while left:
                    size = 1 << (left.bit_length() - 1)
                    part: list[Piece] = []
                    need = size
                    while need:
                        doc, start, ids = pieces.pop(0)
                        part.append((doc, start, ids[: 4 * need]))
                        if len(ids) > 4 * need:
                            pieces.insert(0, (doc, start + need, ids[4 * need :]))
                        need -= len(part[-1][2]) // 4
                    self.done.append(part)
                    left -= size


# The normalizer and pre-tokenizer of definitions whose words can be told apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def word_by_word(definition: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never joins what it divides, as :class:`WordTokenizer` takes for granted."""
    parts = json.loads(definition)
    model, added = parts.get("model") or {}, parts.get("added_tokens") or []
    return (
        parts.get("normalizer") == _NORMALIZER
        and parts.get("pre_tokenizer") == _PRE_TOKENIZER
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added)
    )


class PlainTokenizer:
    """Token ids of whole texts, by any tokenizer."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def ids(self, text: str | None) -> bytes:
        whole = (text or "").encode("utf-8", "replace").decode()
        return np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()


def _letters(word: bytes) -> bool:
    """Whether a word is letters and stays so in lower case."""
    return word.isalpha() or word.decode().lower().isalpha()


class WordTokenizer:
    """Token ids of texts, word by word: this kind of tokenizer never joins what white space divides.

    Two bounded generations of a cache hold the ids of words, so a text mostly costs look-ups: what is in use moves
    to the young one, and the old one goes when the young one is full.
    """

    def __init__(self, definition: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a run of letters
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str | None) -> bytes:
        return b"".join(self._words(part.split()) for part in stretches((text or "").encode("utf-8", "replace")))

    def _words(self, words: list[bytes]) -> bytes:
        cache, old = self.cache, self.old
        new = {w for w in words if w not in cache}
        if len(cache) + len(new) > self.most:
            self.old = old = cache
            self.cache = cache = {}
            new = set(words)
        if new:
            parts = {}
            for word in new:
                known = old.get(word)
                if known is None:
                    parts[word] = self._parts(word)
                else:
                    cache[word] = known
            self._learn({p for both in parts.values() for p in both if p and p not in cache})
            for word, (stem, mark) in parts.items():
                cache[word] = cache[stem] + cache[mark] if mark else cache[stem]
        return b"".join(map(cache.__getitem__, words))

    def _learn(self, unknown: set[bytes]) -> None:
        plain, other = [], []
        for part in unknown:
            (plain if _letters(part) else other).append(part)
        if plain:  # one run of letters each, so their ids can be told apart in one text
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(plain):
                raw = ids.tobytes()
                for part, first, after in zip(plain, [0, *cuts[:-1]], cuts, strict=True):
                    self.cache[part] = raw[first:after]
            else:  # the tokenizer has other letters
                other += plain
        if other:
            for part, found in zip(other, self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False), strict=True):
                self.cache[part] = np.array(found.ids, "<u4").tobytes()

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes]:
        """What a word's ids are made of: letters (ASCII ones in lower case, as the tokenizer has them) and one mark
        after them, which the tokenizer divides from letters. Any other word is left as it is."""
        stem, mark = (word[:-1], word[-1:]) if word[-1:] in _MARKS else (word, b"")
        if stem.isalpha():
            return stem.lower(), mark
        return (stem, mark) if mark and _letters(stem) else (word, b"")


_tokenizers: dict[int, WordTokenizer | PlainTokenizer] = {}


def _tokenizer(definition: Broadcast) -> WordTokenizer | PlainTokenizer:
    """One for each worker process and definition."""
    key = zlib.crc32(definition.value.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        kind = WordTokenizer if word_by_word(definition.value) else PlainTokenizer
        _tokenizers[key] = kind(definition.value)
    return _tokenizers[key]


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, block_tokens: int = 1 << 20, slack: int = 16, most_open: int = 256, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A tokenizer that :func:`word_by_word` knows costs a look-up a word, any other one encodes whole texts. Its definition is read on the driver and broadcast; its size does not depend on the data. Tasks are
    independent (nothing is shuffled), a task holds one block of tokens and ``most_open`` open windows, and it gives
    the same sequences when it is run again: sequence_id is its partition's number and a counter.

    Defined cases: null and empty texts are the end id alone; ids may be null or repeated, each row is a document of
    its own; a document of any length is cut into full windows; an empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    full = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition)
        packer = Packer(window, slack, most_open)
        first = TaskContext.get().partitionId() << 32
        given = 0
        names: dict[int, tuple[object, int]] = {}  # id and tokens of the documents with pieces that are not out yet
        block: list[Piece] = []
        size = row = 0
        id_type = None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal given
            rows = []
            for pieces in packer.done:
                offset = 0
                for doc, start, ids in pieces:
                    length = len(ids) // 4
                    rows.append((*names[doc], start, length, zlib.crc32(ids), first + given, offset, ids))
                    offset += length
                given += 1
            packer.done = []
            if rows:
                ids, tokens, start, length, crc, sequence, offset, raw = zip(*rows, strict=True)
                columns = [pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES + ["ids"] * with_ids)
            kept = {p[0] for ws in packer.open.values() for w in ws for p in w}
            for doc in [d for d in names if d not in kept]:
                del names[doc]

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokenizer.ids(text.as_py()) + end
                names[row] = key.as_py(), len(ids) // 4
                whole = len(ids) // full * full
                packer.done += [[(row, at // 4, ids[at : at + full])] for at in range(0, whole, full)]
                if whole < len(ids):
                    block.append((row, whole // 4, ids[whole:]))
                size += len(ids) // 4
                row += 1
                if size >= block_tokens:
                    packer.pack(block)
                    block, size = [], 0
                    yield from out()
        packer.pack(block)
        packer.finish()
        yield from out()

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
