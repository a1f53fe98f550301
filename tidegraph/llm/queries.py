"""The registered queries of the training-data operators: thin digests over the operators' own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lm, near_dup, pii, quality, secrets, toxicity, warc
from .util import id_remainder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = quality.quality(table(spark, sf_dir, "documents"))
    return d.select("row.doc_id", *[F.col(f"q.{c}").alias(c) for c in base], "base_failed", "kept")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(table(spark, sf_dir, "documents"), reach=None)
    digest = F.sha2(secrets.joined("base_spans").cast("binary"), 256)
    return d.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.joined("spans").alias("spans"), "n_linked")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_dup.classes(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    return d.select("doc_id", *map(number, ("email", "ip", "card", "phone")), F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    profiles = langid.train(docs.filter(~held_out))
    return langid.predict(docs, profiles, keep=[held_out.alias("held_out")])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, classifier, keep=[held_out.alias("held_out")])


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 1
    model = lm.train(docs.filter(~held_out))
    return lm.score(docs, model, keep=[held_out.alias("held_out")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc": op10_warc,
}
