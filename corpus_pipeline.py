"""Corpus cleaning in stages: toxicity, line dedup, near-duplicates, benchmark leaks, encoding.

Every stage reads what its predecessor kept, and all but the last return the columns of ``documents``.

* ``toxicity``: documents with a score of 0.5 or more go.
* ``line_dedup``: lines that repeat an earlier line go; a document that loses all its words goes with them; ``n_chars`` follows
  the text.
* ``near_dedup``: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest ``doc_id`` stays.
* ``decontamination``: documents with a passage of a benchmark item go.
* ``encoding``: the four best segmentations of each text, and whether decoding gives the text back.

Rows without ``doc_id`` pass the third and fourth stage, since no result can name them.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockrisk.llm import decontamination, line_dedup, minhash_dedup, piece_lattice, toxicity
from stockrisk.llm.blocks import table, without_ids
from stockrisk.session import written

ROOT = str(Path(__file__).resolve().parent)


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in their order and types: ``doc_id`` and ``text`` of ``df``, the others out of its ``rest``."""
    columns = [
        (F.col(name) if name in ("doc_id", "text") else F.col(f"rest.`{name}`")).cast(kind).alias(name)
        for name, kind in like.dtypes
    ]
    return df.select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return restored(scored.where("predicted = 0"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_lines(docs)
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = restored(cleaned, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(docs)
    return without_ids(docs, written(found.where("NOT kept").select("doc_id").distinct(), "duplicates"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(written(found, "leaks"), "doc_id", "left_anti").select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_digests(docs).select("doc_id", "best", F.col("decoded").alias("round_trip"))


def _importable(stage):
    """Python workers on this machine find the package whatever the current folder; a cluster gets it with the job."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _importable(toxicity_stage)),
    ("line_dedup", _importable(line_stage)),
    ("near_dedup", _importable(near_stage)),
    ("decontamination", _importable(leak_stage)),
    ("encoding", _importable(encoding_stage)),
]

ORACLE_SQL = None  # the model and the hashes of the stages are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else written(docs, name), sf_dir)
    return docs
