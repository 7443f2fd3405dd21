"""The registered queries of this folder: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import (
    bpe, fingerprints, hard_negatives, html_text, jaccard, lm, neighbours, packing, quality, repair, token_blocks,
    toxicity, weak_rules,
)
from logwarden.llm.common import table, vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def token_output(spark: SparkSession, sf: str) -> DataFrame:
    return token_blocks.token_round_trip(spark, table(spark, sf, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2)


def best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def bpe_coding(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.coding_digests(table(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"))


def syncmer_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


def jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    groups = jaccard.jaccard_groups(spark, table(spark, sf, "documents"), size=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


def lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm.score_corpus(spark, table(spark, sf, "documents"), held_out)


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages"))


def toxicity_grades(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.grade_texts(docs, toxicity.fit_toxicity(docs, table(spark, sf, "labels")))


def quality_classes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.quality_scores(docs, table(spark, sf, "labels"), F.col("source"), F.col("lang"))


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(spark, table(spark, sf, "embeddings"))


def threshold_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(spark, table(spark, sf, "embeddings"), moved, lambda vec_id: vec_id % 100 == 0)


def conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(table(spark, sf, "conversations")))


def rule_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged, _ = weak_rules.quality_votes(table(spark, sf, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "p_good")


def registered() -> dict[str, Query]:
    return {
        "op1_lm_scores": lm_scores,
        "op2_token_blocks": token_output,
        "op3_page_differencing": page_text,
        "op4_ordinal_toxicity": toxicity_grades,
        "op5_site_quality": quality_classes,
        "op6_ngram_jaccard": jaccard_join,
        "op7_closed_syncmers": syncmer_fingerprints,
        "op8_best_fit_packing": best_fit,
        "op9_hilbert_neighbours": nearest_vectors,
        "op10_forced_boundary_bpe": bpe_coding,
        "op11_threshold_negatives": threshold_negatives,
        "op12_conversation_repair": conversation_repair,
        "op13_weak_supervision": rule_quality,
    }
