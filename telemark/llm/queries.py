"""The thirteen operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.llm import ann, best_fit, bpe, chat, filter_audit, html, jaccard_join, lm, negatives, packing, paragraphs, quality, spotsigs
from telemark.llm.rows import read


def op1_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.crf_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_max_scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled good."""
    target = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(read(spark, sf_dir, "documents"), target)


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.neighbour_pairs(read(spark, sf_dir, "conversations")))


def op6_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), digests=True)


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read(spark, sf_dir, "documents"))


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of paragraphs that have a like in another place, and which of each cluster stays."""
    return paragraphs.repeated_paragraphs(read(spark, sf_dir, "documents"))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_packed(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_one_bit_codes, op2_crf_quality, op3_max_scoring_run, op4_cross_entropy_difference, op5_preference_pairs,
        op6_two_tier_bpe, op7_token_group_join, op8_spotsigs, op9_shortest_pack_first, op10_paragraph_minhash,
        op11_best_two_fit, op12_filter_audit, op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op5_preference_pairs": chat.PREFERENCE_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_hard_negatives": negatives.NEGATIVES_SQL,
}
