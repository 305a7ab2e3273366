"""A corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, langid, linededup, packing, similar
from nearfield.llm.common import executors_tidied, new_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with enough confidence; nulls and texts without a letter go.

    Rows are judged by their text alone: equal rows stay or go together, null ids are like any other; without a
    labelled row nothing can be told, so all go; an empty table stays empty.
    """
    model = langid.fit(docs, key=F.xxhash64("doc_id", "text"))
    return docs.where(~langid.predicted(docs, model)["rejected"])


def _has_long_line(text: Column) -> Column:
    """Whether a line has three words or more, or 20 characters or more between its ends."""
    return text.rlike(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]|[^\x20\x09-\x0D][^\n]{18,}[^\x20\x09-\x0D]")


def _free_names(docs: DataFrame, count: int) -> list[str]:
    """Column names that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [n for n in (f"helper_{k}" for k in range(count + len(taken))) if n not in taken][:count]


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines of any length.

    A document that lost a line goes if it has no word left, or if it had longer lines and only short ones are left.
    Null texts stay null; rows that repeat both id and text are one document and get the same text; rows that share an
    id or have none are told apart by their texts; an empty table stays empty.
    """
    names = docs.columns
    long, n_lines, out = _free_names(docs, 3)
    found = linededup.deduplicated(docs.withColumn(long, _has_long_line(F.col("text"))), min_words=1, counts=(n_lines, out))
    kept = found.where((F.col(out) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).where((F.col(out) == 0) | ~F.col(long) | _has_long_line(F.col("text")))
    return kept.withColumn("n_chars", F.when(F.col(out) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: a Jaccard similarity of 0.8 or more over shingles of five words.

    Pairs are found by SimHash fingerprints under a Hamming bound, and those beyond it by min-hash bands; both are checked.
    The row with the smallest id stays, nulls last; see :func:`similar.first_rows` for ids that are null or shared,
    repeated rows and blank texts.
    """
    return similar.first_rows(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item.

    Rows are judged by their text alone: null texts hold none, equal rows stay or go together; without benchmark items
    all stay; an empty table stays empty.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~decontaminate.contaminated(docs, items))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences. Every row is a document of its own, whatever its id; null texts are empty."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _tidy(stage):
    """``stage``, before which executors give back what the stages before it took."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        executors_tidied(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _tidy(stage)) for name, stage in [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("packing", pack)]]

#: Learned languages, 64-bit fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
