"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run()
writes every stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.llm.runtime import drop, read_table, temporary, work_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The classifier learns from this stage's own rows.

    Null texts count as empty; without labels of both classes no document goes.
    """
    from textcurate.llm.toxicity import reject, train

    return reject(docs, train(docs, read_table(spark, sf_dir, "labels")), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links of 0.8 hold together, the row of the smallest (id, text hash) stays.

    Null ids come last and equal rows are one; texts without words are linked with nothing and stay.
    """
    from textcurate.llm.jaccard_join import drop_near_copies

    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go. Null and empty texts and an empty benchmark hit nothing."""
    from textcurate.llm.decontaminate import contaminated_keys

    found = contaminated_keys(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(found, F.xxhash64("text").eqNullSafe(found["th"]) & F.hash("text").eqNullSafe(found["th2"]), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of secrets become a mark and n_chars follows. Null texts stay null; no rows give none."""
    from textcurate.llm.secrets import redact

    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, n_decoded, round_trip: the encoded corpus, decoded for proof.

    A row for each row; null texts have no tokens; no rows give none.
    """
    from textcurate.llm.pieces import Tokenizer

    return Tokenizer(spark).report(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("sentencepiece", pieces),
]

#: SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that a stage needed, and its input, are deleted once its rows are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_dir(spark, "pipeline-" + name.replace(" ", "-"))
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
