"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

Candidates, features and the forest are column expressions; the forest is grown on the driver from a bounded set of
labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import trees
from nearfield.llm.urlfilter import _entropy

# What a candidate looks like, words that announce a secret, words that a placeholder is made of.
# A candidate is a value of any length and characters that is assigned to an announcing word, a password in a URL, a
# bearer token, a string with a known prefix, or a long string with a digit anywhere.
_WORDS = r"(?i:pass|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|login|user)[\w-]{0,16}"
_SIGN = r"[\"'`]?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}"
_QUOTED = [rf"(?<=[:=>][ \t]{{0,3}}{q})(?<={_WORDS}{_SIGN}{q})[^{q}\n]+(?={q})" for q in "\"'`"]
_BARE = rf"(?<=[:=>][ \t]{{0,3}}[\"'`]?)(?<={_WORDS}{_SIGN}[\"'`]?)(?![:=>])[^\s\"'`]*[^\s\"'`,;.!?)\]]"
_IN_URL = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@]+(?=@)"
_BEARER = r"(?<= )(?<=(?i:\bbearer) )[^\s\"'`,;]+"
_PREFIXED = r"(?<![A-Za-z0-9_+/-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_+/-])|(?:gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)"
_LONG = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}"
CANDIDATE = "|".join([*_QUOTED, _BARE, _IN_URL, _BEARER, _PREFIXED, _LONG])
ANNOUNCING = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|login)"
DICTIONARY = (
    "example", "sample", "test", "dummy", "change", "changeme", "password", "secret", "token", "your", "here", "key", "api", "user", "admin",
    "default", "none", "null", "value", "string", "placeholder", "version", "release", "build", "commit", "image", "photo", "file", "page",
    "chapter", "section", "item", "order", "number", "report", "draft", "final", "copy", "main", "index", "article", "news", "the", "and", "for",
)
_OPEN, _CLOSE = "", ""
_BEFORE, _AFTER = 48, 16

FEATURES = ("length", "transitions", "coverage", "digits", "uppers", "entropy", "hex_only", "slashes", "path_before", "path_after", "announced", "assigned", "near_announced")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nth, finding, before, after): every candidate of every text with some characters on either side."""
    text = F.col(text_col).cast("string")
    for mark in (_OPEN, _CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    marked = F.regexp_replace(text, CANDIDATE, f"{_OPEN}$0{_CLOSE}")
    parts = docs.select(F.col(id_col).alias("id"), F.split(marked, _OPEN, -1).alias("parts"))
    parts = parts.where(F.size("parts") > 1)

    def finding(k: Column) -> Column:
        own, last = F.get("parts", k), F.get("parts", k - 1)
        return F.struct(
            F.substring_index(own, _CLOSE, 1).alias("finding"),
            F.replace(F.right(last, F.lit(_BEFORE)), F.lit(_CLOSE), F.lit("")).alias("before"),
            F.substring(F.substring_index(own, _CLOSE, -1), 1, _AFTER).alias("after"),
        )

    found = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), finding)
    return parts.select("id", F.posexplode(found).alias("nth", "x")).select("id", "nth", "x.finding", "x.before", "x.after")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with a column for each of FEATURES."""
    own, length = F.col("finding"), F.length("finding").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "B"), "[^0aB]", "-")
    stretches = F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))
    known = F.regexp_replace(F.lower(own), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")
    share = lambda pattern: F.round(F.length(F.regexp_replace(own, f"[^{pattern}]", "")) / length, 6)
    flag = lambda x: x.cast("double")
    values = {
        "length": length,
        "transitions": F.round((stretches - 1) / F.greatest(length - 1, F.lit(1.0)), 6),
        "coverage": F.round(1 - F.length(known) / length, 6),
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "entropy": _entropy(own),
        "hex_only": flag(own.rlike(r"^([0-9a-f]+|[0-9A-F]+)$")),
        "slashes": (F.length(own) - F.length(F.replace(own, F.lit("/"), F.lit("")))).cast("double"),
        "path_before": flag(F.col("before").rlike(r"[./\\:~]$|(?i)(https?|ftp)\S*$")),
        "path_after": flag(F.col("after").rlike(r"^[./\\:]\w")),
        "announced": flag(F.col("before").rlike(ANNOUNCING + r"\W{0,6}$")),
        "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"'`]?$")),
        "near_announced": flag(F.col("before").rlike(ANNOUNCING)),
    }
    return found.withColumns(values)


@dataclass
class SecretModel:
    """A forest whose mean vote is the share of true findings; without trees every candidate counts."""

    forest: list
    threshold: float = 0.5

    def score(self) -> Column:
        if not self.forest:
            return F.lit(1.0)
        return F.round(trees.total(self.forest, [F.col(f) for f in FEATURES]) / len(self.forest), 6)


def fit(labelled: DataFrame, most_rows: int = 5_000) -> SecretModel:
    """Grows the forest from at most ``most_rows`` labelled findings: (finding, before, after, label 0/1).

    Only features and labels come to the driver; rows without a label are left out.
    """
    rows = labelled.where("label is not null and finding is not null").select("finding", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("int").alias("y"))
    found = with_features(rows).select(*FEATURES, "y", F.xxhash64("finding", "before", "after").alias("at")).orderBy("at", "y").limit(most_rows).collect()
    if not found:
        return SecretModel([])
    x = np.array([[r[f] for f in FEATURES] for r in found], float)
    return SecretModel(trees.forest(x, np.array([r["y"] for r in found])))


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, nth (its place among the text's candidates), finding, before, after, score, is_secret.

    A value that is assigned to an announcing word, and one with a known prefix, is a candidate whatever its length and
    characters; any other string has 12 characters or more and a digit somewhere.

    Defined cases: null and empty texts have no candidates; whole texts are read and a candidate has any length; a
    text that holds the two private-use characters U+E000 and U+E001 is read as if they were blanks; ids may be null
    or repeated, each row is a text of its own; an empty table gives no rows; other columns are not read.
    """
    rows = with_features(candidates(docs, id_col, text_col)).withColumn("score", model.score())
    return rows.select(F.col("id").alias(id_col), "nth", "finding", "before", "after", "score", (F.col("score") >= model.threshold).alias("is_secret"))


def redacted(found: DataFrame) -> DataFrame:
    """Findings without the secret itself: its length and digest stay."""
    return found.withColumns({"length": F.length("finding"), "finding_sha256": F.sha2(F.col("finding").cast("binary"), 256)}).drop("finding", "before", "after")


def example_labels(count: int = 1_600, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Labelled findings made by rule: keys and passwords where they are announced or of a known form, and numbers,
    dates, paths, digests and placeholders that only look like them."""
    rng = np.random.default_rng(seed)
    draw = lambda letters, n: "".join(rng.choice(list(letters), int(n)))
    low, hexes, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    mixed, upper = low + low.upper() + digits, low.upper() + digits
    words = lambda n: " ".join(draw(low, rng.integers(2, 9)) for _ in range(int(n)))
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "PASSWORD", "TOKEN", "Secret"]
    out = []
    for k in range(count):
        before, after = words(6) + " ", " " + words(2)
        kind = k % 12
        if kind < 3:
            value = draw(hexes, rng.choice([16, 18, 24, 32, 40, 64]))
        elif kind == 3:
            value = draw(mixed, rng.integers(16, 48))
        elif kind == 4:
            value = "AKIA" + draw(upper, 16)
        elif kind == 5:
            value = draw(mixed + "+/", rng.integers(30, 60)) + "="
        if kind < 6:
            if kind != 4:
                quote = str(rng.choice(["", '"', "'"]))
                before += str(rng.choice(keys)) + str(rng.choice(["=", " = ", ": ", ":"])) + quote
                after = quote + after
            value = value.upper() if kind < 3 and rng.random() < 0.15 else value
            out.append((value + ("0" if value.isalpha() else ""), before[-_BEFORE:], after[:_AFTER], 1))
            continue
        if kind == 6:
            value = draw(digits, rng.choice([12, 13, 14, 15, 16, 19]))
        elif kind == 7:
            value = f"20{draw(digits, 2)}-{draw(digits, 2)}-{draw(digits, 2)}-{draw(low, 6)}"
        elif kind == 8:
            value, before = "/".join(draw(low, 5) for _ in range(3)) + "/" + draw(digits, 4), before + str(rng.choice(["https://", "./", "see "]))
        elif kind == 9:
            value, before = draw(hexes, 40), before + str(rng.choice(["commit ", "sha1 ", "digest ", "revision "]))
        elif kind == 10:
            value = str(rng.choice(["example", "changeme", "your_api_key_here", "test_password", "dummy-secret"])) + draw(digits, rng.integers(1, 5)) + "-value"
            before += str(rng.choice(keys)) + "="
        else:
            value = draw(low, rng.integers(4, 9)) + str(rng.choice(["-", "_"])) + draw(low, rng.integers(4, 9)) + draw(digits, 2)
        out.append((value, before[-_BEFORE:], after[:_AFTER], 0))
    return out + _assigned_labels(count // 2, seed + 1)


def _assigned_labels(count: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Labelled values behind an announcing word: short passwords, pass phrases and keys without a digit; and words,
    numbers, variables and masks."""
    rng = np.random.default_rng(seed)
    draw = lambda letters, n: "".join(rng.choice(list(letters), int(n)))
    low, digits, signs = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*?"
    words = lambda n, by=" ": by.join(draw(low, rng.integers(3, 9)) for _ in range(int(n)))
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "auth_token", "PASSWORD", "login"]
    out = []
    for k in range(count):
        before, after = words(6) + " ", " " + words(2)
        quote = str(rng.choice(["", '"', "'"]))
        kind = k % 8
        if kind == 0:
            value = draw(low, rng.integers(4, 8)) + draw(digits, rng.integers(1, 4))
        elif kind == 1:
            letters = list(draw(low, 4) + draw(low.upper(), 2) + draw(digits, rng.integers(1, 3)) + draw(signs, rng.integers(1, 3)))
            value = "".join(rng.permutation(letters))
        elif kind == 2:
            value = words(rng.integers(3, 6), str(rng.choice(["-", "_", "."])))
        elif kind == 3:
            value = "AKIA" + draw(low.upper(), 16) if rng.random() < 0.5 else draw(low + low.upper(), rng.integers(16, 40))
        elif kind == 4:
            value = draw(low, rng.integers(2, 11))
        elif kind == 5:
            value = draw(digits, rng.integers(1, 6))
        elif kind == 6:
            name = str(rng.choice(["password", "token", "secret", "your_key", "value"]))
            value = str(rng.choice(["${%s}", "<%s>", "{{%s}}", "$%s", "%%%s%%"])) % (name.upper() if rng.random() < 0.5 else name)
        else:
            value = str(rng.choice(["****", "********", "xxxx", "none", "null", "changeme", "example", "test", "your-password-here", "required"]))
        if kind == 3 and value.startswith("AKIA"):
            quote = ""
        else:
            before += str(rng.choice(keys)) + str(rng.choice(["=", " = ", ": ", ":"])) + quote
        out.append((value, before[-_BEFORE:], (quote + after)[:_AFTER], int(kind < 4)))
    return out


def example_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(example_labels(), "finding string, before string, after string, label int")
