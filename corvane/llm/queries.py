"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import divergence, exact_dedup, hard_negatives, html_extract, mixing, quality_lines, sentencepiece_codec, simhash, spotsigs, token_counts, token_files, toxicity, url_filter
from corvane.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, component and number of links of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality_lines.judge_documents(table(spark, sf_dir, "documents")).drop("failed_lines")


ORACLES["op7_line_quality"] = quality_lines.ORACLE_SQL


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document, in words, beside its source's size and target."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col("__size") * F.size("__draws")
    return plan.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))


ORACLES["op8_source_mixing"] = mixing.ORACLE_SQL


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


ORACLES["op2_url_filters"] = url_filter.ORACLE_SQL


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labelled rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


def tokenizer_file(name: str) -> str:
    """The text of a public tokenizer's vocabulary file, read once on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files written of all of them."""
    path = token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, scanned from flat files of ids that end in the vocabulary's free id."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(documents, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


@query
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, beside its edited text's and the next document's."""
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def piece_model() -> bytes:
    """A public merge-type SentencePiece model, read once on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under seeded dropout, and whether they decode to its text."""
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and which of them stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op13_exact_dedup"] = exact_dedup.ORACLE_SQL


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's distance from every other of its language, and the terms that tell it from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.ORACLE_SQL


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of other labels that score just below each positive of each anchor."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


ORACLES["op11_hard_negatives"] = hard_negatives.ORACLE_SQL
