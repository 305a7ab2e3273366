"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped if an earlier line (by document id, then place) is equal to it or, for lines of ``near_words`` words
and more, within one word of it: a word replaced, put in or left out. Lines are compared by their words, lower-cased.

Lines that can have a partner are found first: within one edit, either the first or the last ``p`` words are equal,
where ``p`` is about half the length, so only lines that share such a half with another go on. They emit all their
variants with one word deleted, as hashed keys. Equal variants with the deletion at the same place differ by a
replaced word at most, so the group's earliest line stands for all of it and no pairs are made; a variant that equals
a whole line is that line with a word more. Each candidate is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, given, stored

_BLANKS = r"[\x20\x09\x0B-\x0D]+"
_TRIM = " \t\x0b\x0c\r"


def _key(own: Column, text: Column) -> Column:
    """A hash of id and text: rows that are equal in both are one document."""
    return F.xxhash64(own.cast("string"), text)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    return docs.select(own.alias("id"), _key(own, text).alias("doc"), text.alias("text"))


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """Every line with ``min_words`` words or more, and one at least: its document and place, its words and their hashes."""
    words = F.transform(F.split(F.lower("text"), "\n", -1), lambda x: F.split(F.btrim(x, F.lit(_TRIM)), _BLANKS, -1))
    rows = documents.select("id", "doc", F.posexplode(words).alias("pos", "words")).where((F.size("words") >= min_words) & (F.get("words", F.lit(0)) != ""))
    return rows.select("id", "doc", "pos", "words", F.size("words").alias("n"), F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"))


def _order() -> Column:
    """Where a line comes first: by id, nulls last, then by document and place."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", "pos")


def _half(n: Column) -> Column:
    """How many words of either end two lines of n and n + 1 words are compared by; even, so it seldom changes."""
    return (F.floor(n / 4) * 2).cast("int")


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and the last words, for the line's own length and, if that compares less, for one less;
    those of the first words are even numbers, the others odd."""

    def both(p: Column) -> list[Column]:
        first, last = F.xxhash64(p, F.slice(words, F.lit(1), p)), F.xxhash64(p, F.slice(words, n - p + 1, p))
        return [first.bitwiseAND(F.lit(-2)), last.bitwiseOR(F.lit(1))]

    own, less = _half(n), _half(n - 1)
    return F.when(own == less, F.array(*both(own))).otherwise(F.array(*both(own), *both(less)))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at an edit distance of one at most."""
    shorter = F.least(F.size(a), F.size(b))
    first = _common(a, b)
    last = F.least(_common(F.reverse(a), F.reverse(b)), shorter - first)
    return F.greatest(F.size(a), F.size(b)) - first - last <= 1


def _near(documents: DataFrame, lines: DataFrame, near_words: int, most_rows: int) -> DataFrame:
    """(h1, h2) of the different lines that have an earlier line within one edit. ``lines`` has each line once."""
    line = ["h1", "h2"]
    long = lines.where(F.col("n") >= near_words)
    keys = long.select(*line, F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    partners = keys.join(shared, "key", "left_semi").groupBy(*line).agg(F.bool_or(~odd).alias("head"), F.bool_or(odd).alias("tail"))
    some = stored(long.join(partners, line).select(*line, "n", "first", "head", "tail"), "partners")

    holders = cut(some.select(F.col("first.doc").alias("doc")).distinct())
    texts = _lines(documents.join(given(holders, most_rows), "doc", "left_semi"), near_words).drop("n")
    texts = texts.join(given(some, most_rows), line).where(_order() == F.col("first"))
    words = F.transform("words", lambda w: F.xxhash64(w)).alias("words")
    texts = stored(texts.select(*line, "n", "head", "tail", words).dropDuplicates(line), "words")

    # only the half that a partner need not share can hold the edit
    n, p = F.col("n"), _half(F.col("n") - 1)
    places = F.filter(F.sequence(F.lit(1), n), lambda k: (F.col("head") & (k > p)) | (F.col("tail") & (k <= n - p)))
    cells = texts.select(*line, "n", "words", F.explode(places).alias("at"))
    left_out = F.xxhash64(F.concat(F.slice("words", F.lit(1), F.col("at") - 1), F.slice("words", F.col("at") + 1, n)))
    cells = cells.select(*line, "n", "at", left_out.alias("v"))
    replaced = F.struct(F.xxhash64("v", "n", "at").alias("key"), F.lit(0).alias("kind"))
    longer = F.struct(F.xxhash64("v", n - 1, F.lit(0)).alias("key"), F.lit(1).alias("kind"))
    variants = cells.select(*line, F.explode(F.array(replaced, longer)).alias("x")).select(*line, "x.key", "x.kind")
    own = texts.select(*line, F.xxhash64(F.xxhash64("words"), "n", F.lit(0)).alias("key"), F.lit(2).alias("kind"))
    variants = stored(variants.union(own), "variants")

    met = variants.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    hot = variants.join(met, "key", "left_semi").join(some.select(*line, "first"), line)
    hot = cut(hot.select("key", "kind", F.struct("first", *line).alias("line")))
    # kind 0: any two are one replaced word apart; kinds 1 and 2: a line with a word more, and the line itself
    least = hot.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("line"))).alias(f"least{k}") for k in range(3)])
    rows = hot.join(least, "key")
    other = F.when(F.col("kind") == 0, F.col("least0")).when(F.col("kind") == 1, F.col("least2")).otherwise(F.col("least1"))
    rows = rows.withColumn("other", other).where(F.col("other.first") < F.col("line.first"))
    pairs = rows.select("line.h1", "line.h2", F.col("other.h1").alias("e1"), F.col("other.h2").alias("e2")).distinct()
    known = texts.select(*line, "words")
    checked = pairs.join(known, line).join(known.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("other_words")), ["e1", "e2"])
    return checked.where(within_one_edit(F.col("words"), F.col("other_words"))).select(*line).distinct()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3, near_words: int = 8, counts: tuple[str, str] | None = None, most_rows: int = 250_000) -> DataFrame:
    """``docs`` with the later of equal and near-equal lines taken out of the text; no row is dropped.

    ``counts`` names two more columns: lines of the text, and lines taken out. Lines with fewer than ``min_words``
    words always stay. Intermediate tables of at most ``most_rows`` rows are broadcast, larger ones are shuffled.

    Words are compared by 96-bit hashes of lines and 64-bit hashes of words.

    Defined cases: a null text stays null and has no lines; an empty text is one line that stays; the order is by id,
    nulls last, then by the text's hash and the place in the text; rows that repeat both id and text are one document
    and get the same text; an empty table stays empty. Columns keep their names and order whatever they are called.
    """
    if near_words < 8:
        raise ValueError("near_words must be 8 at least")
    documents = _documents(docs, id_col, text_col)
    rows = _lines(documents, min_words)
    rows = stored(rows.select("id", "doc", "pos", "n", "h1", "h2", F.when(F.col("n") >= near_words, _halves(F.col("words"), F.col("n"))).alias("halves")), "lines")
    lines = rows.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    lines = stored(lines, "distinct-lines")
    near = _near(documents, lines, near_words, most_rows).withColumn("near", F.lit(True))
    listed = lines.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").where("near or times > 1")
    listed = cut(listed.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    found = rows.select("id", "doc", "pos", "h1", "h2").join(given(listed, most_rows), ["h1", "h2"])
    found = found.where(F.col("near") | (_order() != F.col("first")))
    out = cut(found.groupBy("id", "doc").agg(F.collect_set("pos").alias("out")))

    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("_id"), _key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).alias("_doc"))
    some = given(out, most_rows)
    joined = whole.join(some, (whole["_doc"] == some["doc"]) & whole["_id"].eqNullSafe(some["id"]), "left")
    text = F.col("row").getField(text_col)
    parts = F.split(text.cast("string"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("out"))
    left = F.when(F.col("out").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n"))
    columns = [(left if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    if counts:
        columns += [F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias(counts[0]), F.coalesce(F.size("out"), F.lit(0)).cast("bigint").alias(counts[1])]
    return joined.select(*columns)
