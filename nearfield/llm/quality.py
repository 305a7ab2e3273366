"""Quality rules as a short-circuit cascade.

Each rule reads a few lazily computed measures of a text. Its cost (seconds a megabyte, with the measures that it
needs) and its selectivity (share of texts that it rejects) are estimated on a bounded sample, and rules run in order
of rejections per cost; the first that fails ends the cascade for that text. A text is kept if no rule fails, so the
order changes the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ship, stretches

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_OTHERS = bytes(b for b in range(0x80) if bytes([b]) not in _UPPER + _LOWER + _BLANKS)


class Measures:
    """The measures of one whole text, each computed when it is first asked for. Null is a text without words."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.chars = len(text or "")

    @cached_property
    def _hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        parts = [np.fromiter(map(hash, words), np.int64, len(words)) for words in map(bytes.split, stretches(self.raw))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    @cached_property
    def n_words(self) -> int:
        return len(self._hashes)

    @cached_property
    def word_chars(self) -> int:
        return self.chars - sum(map(self.raw.count, (bytes([b]) for b in _BLANKS)))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (bytes([b]) for b in _SYMBOLS)))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < 4:  # two windows of three words at least
            return 0
        h = self._hashes.view(np.uint64)
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        ranked = np.sort(windows)
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        twice = np.unique(ranked[1:][same])
        again = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
        words = np.zeros(len(h), bool)
        for k in range(3):
            words[k : k + len(again)] |= again
        return int(words.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LOWER))

    @cached_property
    def n_letterless(self) -> int:
        """Words without a letter; anything outside ASCII counts as one."""
        return self.n_words - sum(len(part.split()) for part in stretches(self.raw.translate(None, _OTHERS)))


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a text that the rule rejects. ``base`` marks the rules whose failure is reported apart."""

    name: str
    fails: Callable[[Measures], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m.n_words < 50, base=True),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words, base=True),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: m.n_dup_lines > 2 and 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words),
    Rule("letterless_words", lambda m: 5 * m.n_letterless > m.n_words),
    Rule("shouting", lambda m: m.n_upper > m.n_lower),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample said of a rule."""

    rule: str
    seconds_per_mb: float
    rejected: float


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """By rejections per cost, most first; rules that the sample says nothing of come last, as they were."""
    by = {e.rule: e.rejected / max(e.seconds_per_mb, 1e-9) for e in estimates}
    return tuple(sorted(rules, key=lambda r: -by.get(r.name, -1.0)))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 512) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows, spread by the texts' hashes.

    Texts stay on the executors; the driver gets one row per rule. An empty table gives no estimates.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    if not total:
        return []
    share = min(1.0, 1.2 * sample_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, size, count = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                whole = text.as_py()
                size += len(whole or "")
                count += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    failed[k] += rule.fails(Measures(whole))
                    spent[k] += time.perf_counter() - began
        names = pa.array([r.name for r in rules])
        columns = [names, pa.array(spent), pa.array(failed), pa.array([size] * len(rules), pa.int64()), pa.array([count] * len(rules), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["rule", "spent", "failed", "size", "n"])

    found = sample.mapInArrow(run, "rule string, spent double, failed bigint, size bigint, n bigint").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("failed").alias("failed"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    return [Estimate(r["rule"], r["spent"] / max(r["size"] / 1e6, 1e-6), r["failed"] / max(1, r["n"])) for r in found.collect()]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KIND = pa.struct([(m, pa.int64()) for m in MEASURES] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("failed_rule", pa.string())])


def judged(df: DataFrame, cascade: tuple[Rule, ...], text_col: str = "text", measures: bool = True) -> Column:
    """A struct of the measures, base_failed, kept and failed_rule (the first rule of the cascade that failed).

    With ``measures`` false they are null and only what the cascade comes to is computed; base_failed is then known
    where a base rule ended it. Null, empty and blank texts have no words and are not kept. Whole texts are read.
    """
    ship(df.sparkSession)
    base = [r for r in cascade if r.base]

    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ",base_failed:boolean,kept:boolean,failed_rule:string>")
    def judge(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in _KIND]
        for text in texts:
            m = Measures(text.as_py())
            failed = next((r for r in cascade if r.fails(m)), None)
            basic = any(r.fails(m) for r in base) if measures else failed is not None and failed.base
            row = [*(getattr(m, x) if measures else None for x in MEASURES), basic, failed is None, failed and failed.name]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))

    return judge(F.col(text_col).cast("string"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", measures: bool = True, sample_rows: int = 512) -> Column:
    """Estimates, orders and applies ``rules``; the struct column of :func:`judged` for ``docs``."""
    return judged(docs, ordered(rules, estimate(docs, rules, text_col, sample_rows)), text_col, measures)
