"""The corpus pipeline over `documents`: language ID, SimHash near-dedup, decontamination, secret scan, packing.

Each stage works on all rows that the one before kept. Rows with null texts or without a letter go in the first stage; of rows that
are the same in id and text, one stays after the second; ids may be null and are then compared as equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, lang_id, packing, secrets, simhash

#: The stages are model-based or iterative, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text or no letter) go."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    # all columns travel in one, so that none can meet those of the prediction
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    found = lang_id.predict(rows, lang_id.train(docs.where(~held)), keep=["row"])
    return found.where("lang_pred <> 'und'").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; a null id counts as the smallest. Groups are of five-word shingles, at
    ten bits of 64 and 26 of two fingerprints, which similarity 0.8 mostly stays within."""
    known = docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = common.written(simhash.near_duplicates(known, id_col="__id", words_per_shingle=5, threshold=10, both=26).select("doc_id", "component_id"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = known.join(kept, "__id", "left_semi").select(*docs.columns)
    n, ids = found.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return rows.dropDuplicates(["doc_id", "text"]) if n > ids else rows


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__h"])
    return docs.join(bad, same, "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    names = common.fresh(docs, "findings"), common.fresh(docs, "redacted")
    found = secrets.scan(docs, secrets.fit(secrets.labelled_findings(spark)), path_col="source", names=names)
    changed = {"text": F.col(names[1]), "n_chars": F.length(names[1]).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024 tokens."""
    return packing.pack(common.written(packing.pieces(docs)))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs)
    return docs
