"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams (two to four bytes, ASCII other than letters folded to one blank), hashed
into a fixed number of buckets. Its embedding is the average of their vectors; a linear softmax gives the language.
A temperature fitted on held-back training rows calibrates the probabilities, and a text whose calibrated probability
stays under a threshold from the same rows is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, give_back, given, lean, ship, tidied

BITS = 14
SIZES = (2, 3, 4)
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_STRETCH = 1 << 16
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of the whole text, a stretch at a time."""
    words = text.lower().encode("utf-8", "replace").translate(_FOLD).split()
    raw = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)
    for at in range(0, len(raw), _STRETCH):
        part = raw[at : at + _STRETCH + max(SIZES) - 1].astype(np.uint32)
        own = min(_STRETCH, len(raw) - at)
        gram, found = part, []
        for size in range(2, max(SIZES) + 1):
            gram = gram[:-1] * np.uint32(257) + part[size - 1 :]
            if size in SIZES:
                found.append((gram + np.uint32(size * 7919))[:own])
        yield ((np.concatenate(found) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.intp)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, and the share of its n-grams in each."""
    total = np.zeros(1 << BITS, np.int64)
    for part in buckets(text):
        total += np.bincount(part, minlength=1 << BITS)
    own = np.flatnonzero(total)
    return own.astype(np.int32), (total[own] / max(1, total.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    """The average of ``table`` rows, times ``head``, is a text's logits. With few languages ``table`` has the
    embeddings times the softmax weights already and there is no ``head``, so its width never passes the embeddings'."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    head: np.ndarray | None = None

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(self.table.shape[1], np.float64), 0
        for part in buckets(text):
            if len(part) > 1 << (BITS - 1):
                total += np.bincount(part, minlength=1 << BITS).astype(np.float32) @ self.table
            else:
                total += np.ones(len(part), np.float32) @ self.table.take(part, axis=0)
            count += len(part)
        mean = total / max(1, count)
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dimension: int = 16, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Fits the model to (language, buckets, shares) rows; every fifth row of a shuffle is kept for calibration."""
    languages = sorted({r[0] for r in rows})
    empty = LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.5)
    if not languages:
        return empty
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[::5] if len(rows) >= 5 * len(languages) else order
    fitted = np.setdiff1d(order, held) if len(held) < len(rows) else order
    embedding = rng.normal(0, 0.1, (1 << BITS, dimension)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dimension, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    labels = {name: k for k, name in enumerate(languages)}
    steps, total = 0, epochs * len(fitted)
    for _ in range(epochs):
        for k in rng.permutation(fitted):
            name, own, share = rows[k]
            step = rate * (1 - steps / total)
            steps += 1
            hidden = share @ embedding[own]
            error = _softmax((hidden @ weights + bias)[None])[0]
            error[labels[name]] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            embedding[own] -= (20 * step) * share[:, None] * back
    table, head = (embedding @ weights, None) if len(languages) <= dimension else (embedding, weights)
    means = np.array([rows[k][2] @ table[rows[k][1]] for k in held])
    logits = (means if head is None else means @ head) + bias
    truth = np.array([labels[rows[k][0]] for k in held])
    best = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = _softmax(logits / best)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = min(0.5, float(np.quantile(right, 0.005))) if len(right) else 0.5
    return LanguageModel(languages, table.astype(np.float32), bias.astype(np.float64), float(best), threshold, head)


def _features_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(label.as_py(), *features(text.as_py())) for label, text in zip(batch.column(0), batch.column(1), strict=True) if has_letter(text.as_py())]
        at = [xxhash.xxh64_intdigest(own.tobytes() + share.tobytes()) >> 1 for _, own, share in rows]
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32())), pa.array(at, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "own", "share", "at"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, per_language: int = 400, most_rows: int = 40_000) -> LanguageModel:
    """Trains on a sample of ``labelled``: about ``per_language`` rows of each of its languages, or as many fewer of
    each as keep the whole sample at ``most_rows`` expected; every language takes part, with 16 rows expected at least.

    The sample is what bounds the driver's memory: it gets bucket counts of those rows, as Arrow arrays, never texts.
    ``key`` deals the rows at random (default: the text's hash); it is no feature.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), (F.xxhash64(F.col(text_col)) if key is None else key).alias("key"))
    rows = rows.where("label is not null and text is not null")
    counts = cut(rows.groupBy("label").agg(F.count("*").alias("n")))  # a row for each language
    languages = counts.count()
    if not languages:
        return train([])
    each = max(16, min(per_language, most_rows // languages))
    place = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(given(counts), "label").where(place < each / F.col("n"))
    sample = chosen.limit(2 * each * languages).select("label", "text").mapInArrow(lean(_features_batches), "label string, own array<int>, share array<float>, at bigint")
    model = _trained(sample.toArrow())
    tidied(spark)
    return model


def _trained(sample: pa.Table) -> LanguageModel:
    found = sample.sort_by([("label", "ascending"), ("at", "ascending")]).combine_chunks()
    if not found.num_rows:
        return train([])
    labels = found.column("label").to_pylist()
    own, share = (found.column(c).combine_chunks() for c in ("own", "share"))
    ends = own.offsets.to_numpy()
    flat, shares = own.values.to_numpy(), share.values.to_numpy()
    return train([(label, flat[a:b], shares[a:b]) for label, a, b in zip(labels, ends[:-1].tolist(), ends[1:].tolist(), strict=True)])


_KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predicted(df: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A struct of lang_pred, score and rejected for the text column of ``df``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; texts of any length are read whole;
    equal texts get equal verdicts and rows that repeat each their own; an empty table has none; no other column is
    read, whatever it is called.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size, and a row of weights for each language

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        own = shared.value
        rows = [own.predict(x.as_py()) for x in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [(), (), ()], _KIND, strict=True)], fields=list(_KIND))

    return predict(F.col(text_col).cast("string"))
