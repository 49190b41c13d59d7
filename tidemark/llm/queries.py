"""Queries opN_<name> over the whole tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, chat, decontaminate, embeddings, lang_id, licenses, packing, quality, repeats, secrets, simhash, topk
from .common import table, written


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each document as counts, spans and the digest of the redacted text; `source` serves as path."""
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model, path_col="source")
    hits = F.filter("findings", lambda f: f["secret"])
    spans = F.transform(hits, lambda f: F.concat(f["start"].cast("string"), F.lit("+"), f["length"].cast("string")))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(hits).cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("spans"),
        F.array_max(F.transform("findings", lambda f: f["score"])).alias("max_score"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), "posterior", "score", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(written(packing.pieces(table(spark, sf_dir, "documents"))))


def op5_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every message with its place and canonical line."""
    return chat.link(table(spark, sf_dir, "conversations"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold crc32(id) mod 4 = 2 is held out of the fit; the prediction reads the text alone."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lang_id.train(docs.where(~held))
    found = lang_id.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by language."""
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by quantised inner product of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens; the groups themselves as a digest."""
    found = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    found = written(found.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    return alignment.score(found, alignment.n_pieces()).drop("row")


QUERIES = (
    op1_secret_scan, op2_embedding_near_dedup, op3_quality_classifier, op4_best_fit_packing, op5_chat_linking,
    op6_simhash_near_dedup, op7_suffix_repeats, op8_decontaminate, op9_license_scan, op10_language_id,
    op11_filter_audit, op12_exact_top_k, op13_token_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Where there is none, SQL can't express the query (trees, hashes, tokenizers) or not in useful time (all 400-byte strings)."""
    return {"op2_embedding_near_dedup": embeddings.SQL, "op8_decontaminate": decontaminate.SQL, "op9_license_scan": licenses.sql(), "op11_filter_audit": audit.SQL, "op12_exact_top_k": topk.SQL}
