"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

The trees are grown on the driver from a bounded labelled sample and applied as column expressions; nothing but
DataFrame functions runs on the URLs that are judged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import trees
from nearfield.llm.common import lower_ascii

FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "longest_label", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _count(value: Column, part: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(part), F.lit("")))


def _entropy(value: Column) -> Column:
    """Bits a character, rounded to six digits; 0 for an empty value."""
    chars = F.split(value, "")
    size = F.length(value).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size)
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(value) == 0, 0.0).otherwise(F.round(bits, 6))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features but for the suffix statistic, by name."""
    whole = F.coalesce(url, F.lit(""))
    length = F.length(whole)
    labels = F.split(host, r"\.")
    return {
        "length": length.cast("double"),
        "depth": _count(path, "/").cast("double"),
        "digit_ratio": F.when(length == 0, 0.0).otherwise(F.round(F.length(F.regexp_replace(whole, "[^0-9]", "")) / length.cast("double"), 6)),
        "entropy": _entropy(host),
        "params": _count(F.regexp_extract(whole, r"\?([^#]*)", 1), "=").cast("double"),
        "hyphens": _count(host, "-").cast("double"),
        "labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
    }


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.element_at(F.split(host, r"\."), -1)


@dataclass
class UrlModel:
    """Boosted trees and, by suffix, the smoothed share of blocked URLs among the labelled ones."""

    trees: list
    shares: dict[str, float]
    prior: float

    def log_odds(self, url: Column, host: Column, path: Column) -> Column:
        return trees.total(self.trees, [*lexical(url, host, path).values(), self.suffix_share(host)])

    def suffix_share(self, host: Column) -> Column:
        if not self.shares:
            return F.lit(self.prior)
        known = F.create_map(*[x for k, v in self.shares.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(known, suffix(host)), F.lit(self.prior))


def lexical_row(url: str | None) -> tuple[list[float], str]:
    """The same features of one URL, and its suffix, for training."""
    whole = url or ""
    rest = whole.partition("://")[2]
    place = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if c.isascii() else c for c in place[1]), place[2]
    query = re.search(r"\?([^#]*)", whole)
    shares = [host.count(c) / len(host) for c in dict.fromkeys(host)]
    values = [
        len(whole),
        path.count("/"),
        round(sum(c in "0123456789" for c in whole) / max(1, len(whole)), 6),
        round(-sum(p * math.log2(p) for p in shares), 6),
        query[1].count("=") if query else 0,
        host.count("-"),
        host.count(".") + 1,
        max(map(len, host.split("."))),
    ]
    return [float(v) for v in values], host.rpartition(".")[2]


def train(rows: list[tuple[str | None, int]], most_suffixes: int = 64) -> UrlModel:
    """The model of labelled (URL, 1 if blocked) rows."""
    if not rows:
        return UrlModel([], {}, 0.0)
    found = [lexical_row(url) for url, _ in rows]
    y = np.array([label for _, label in rows], float)
    prior = round(float(y.mean()), 6)
    names = np.array([suffix for _, suffix in found])
    common, counts = np.unique(names, return_counts=True)
    chosen = sorted(common[np.argsort(-counts, kind="stable")][:most_suffixes].tolist())
    shares = {s: round(float((y[names == s].sum() + 5 * prior) / ((names == s).sum() + 5)), 6) for s in chosen}
    x = np.array([values + [shares.get(suffix, prior)] for values, suffix in found])
    return UrlModel(trees.boosted(x, y), shares, prior)


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most_rows: int = 20_000) -> UrlModel:
    """Trains on at most ``most_rows`` rows of ``labelled``, spread by hash; rows without a label are left out."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("y"))
    found = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most_rows).collect()
    return train([(r["url"], r["y"]) for r in found])


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains if the URL's path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, log_odds (of being blocked).

    The longest rule that fits decides; without one the model does. ``rules`` is a short list that becomes part of
    the expression. Null URLs and those without ``://`` have an empty host and path, so no rule fits and the model
    judges them by the rest; ids may be null or repeated; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = verdict = None
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last one asked is the longest
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, "allow" if r.allow else "block").otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    none = F.lit(None).cast("string")
    rows = rows.withColumn("log_odds", model.log_odds(F.col("url"), F.col("host"), F.col("path")))
    return rows.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        (none if rule is None else rule).alias("rule"),
        F.coalesce(none if verdict is None else verdict, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"),
        "log_odds",
    )


def example_labels(count: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled URLs made by rule: compound or numbered hosts are blocked, plain ones allowed, with some of each kind
    the other way round."""
    rng = np.random.default_rng(seed)
    part = lambda low, high: "".join(rng.choice(list("aeioubcdfghklmnprst"), rng.integers(low, high)))
    out = []
    for _ in range(count):
        blocked = bool(rng.random() < 0.4)
        kind = rng.random()
        name = part(3, 10)
        if blocked and kind < 0.85 or not blocked and kind < 0.02:
            name = f"{part(3, 7)}-{part(1, 7)}" + (f"-{part(3, 6)}" if rng.random() < 0.2 else "")
        elif blocked:
            name = part(3, 7) + str(rng.integers(1000, 999999))
        front = str(rng.choice(["", "", "www.", "m.", "blog."]))
        path = f"/{rng.choice(['en', 'de', 'fr', 'es', 'news', 'a/b'])}/{rng.integers(1, 10 ** int(rng.integers(1, 7)))}"
        tail = str(rng.choice(["", "/", ".html", "#top", "?utm_source=feed", "?page=2&ref=x"]))
        out.append((f"http{'s' if rng.random() < 0.7 else ''}://{front}{name}.example.{rng.choice(['com', 'net', 'org'])}{path}{tail}", int(blocked)))
    return out
