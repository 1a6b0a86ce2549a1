"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import edit_fingerprints, lm_score, media, merkle, mixing, pieces, rotation_codes, simhash, substrings, token_counts, toxicity, treaps, url_filters
from .shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document as a digest, and whether they decode to its text."""
    return pieces.digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of every document that mix its domains to the target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-embedding fingerprints of every document and of its edited text, compared."""
    return edit_fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transport stream, read back and digested."""
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the model and its base."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that near-repeat in a document with a smaller id."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by the rules of its contract."""
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.CONTRACT_RULES)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return rotation_codes.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return treaps.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and the root folded again, of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


import corpus_pipeline  # noqa: E402  deleted together with this package

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_mixing, op4_document_fingerprints, op5_toxicity, op6_media_columns, op7_lm_scoring, op8_substring_dedup, op9_simhash_near_dedup, op10_url_filters, op11_embedding_near_dedup, op12_ranked_search, op13_merkle_manifest)}
QUERIES["pipeline"] = corpus_pipeline.query
ORACLE_SQL: dict[str, str] = {"op10_url_filters": url_filters.oracle(), "op11_embedding_near_dedup": rotation_codes.oracle(), "op12_ranked_search": treaps.oracle(), "op13_merkle_manifest": merkle.oracle()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
