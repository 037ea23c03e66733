"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages keep whole rows: null texts count as empty (too short, so the quality
stage drops them); rows of one id are judged each by the row stages, and the
near-duplicate stage keeps one row per group (smallest id, null last, then
text), whatever ids the rows have; of repeated rows so does one stay. An empty table
passes every stage empty. Texts are read whole. Stages carry the five columns of
documents; columns beside them are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskgrid.llm import decontam, quality_rules, secrets, sentencepieces, simhash
from taskgrid.llm.common import ship, table
from taskgrid.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (operator 5) keep."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (operator 6): smallest id (null last), then text."""
    ship(spark)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *COLUMNS)
    # rows meet their group by fingerprint, never by id; partial minima keep a hot group small
    path = scratch_path(spark, "near-dedup")
    (docs.withColumn("fp", simhash.fingerprint(F.col("text"))).groupBy("fp").agg(F.min(row).alias("r"))
     .write.parquet(path))
    firsts = spark.read.parquet(path)
    comp = simhash.components(simhash.links(firsts.select("fp")))
    rooted = firsts.join(comp, firsts.fp == comp.node, "left").select(F.coalesce("root", "fp").alias("root"), "r")
    return rooted.groupBy("root").agg(F.min("r").alias("r")).select(*[f"r.{c}" for c in COLUMNS])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 3)."""
    found = decontam.with_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("matches") == 0).select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced (operator 1); n_chars follows the new text."""
    ship(spark)
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their best segmentation (operator 8) and whether decoding them gives the text."""
    ship(spark)
    return sentencepieces.encode(docs.select(*COLUMNS), check=True).select(
        *COLUMNS, F.col("pieces.ids").alias("piece_ids"), F.element_at("pieces.scores", 1).alias("piece_score"),
        F.col("pieces.round_trip").alias("round_trip"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate),
          ("secret_scan", remove_secrets), ("sentencepiece", encode)]
ORACLE_SQL = None  # learned rules, fingerprints and lattices have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
