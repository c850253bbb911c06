"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.brown import class_model_scores
from tidewell.llm.collocations import collocations
from tidewell.llm.decontaminate import find_contamination
from tidewell.llm.fim import fill_in_middle, restored
from tidewell.llm.html_text import extract_text
from tidewell.llm.jaccard import ngram_jaccard_join
from tidewell.llm.langid import fold, identify_language
from tidewell.llm.line_dedup import kept_lines, line_keep_bitmaps
from tidewell.llm.mixing import mix_sources
from tidewell.llm.suffixes import passage_report
from tidewell.llm.urls import url_filter
from tidewell.llm.vptree import nearest_neighbours
from tidewell.llm.warc import warc_round_trip

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LANGUAGE_FOLDS, LANGUAGE_HELD = 3, 1
QUERY_STEP = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("hit_words").cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_round_trip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model_scores(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD
    found = identify_language(documents.select("doc_id", "text"), documents.where(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = kept_lines(documents, line_keep_bitmaps(documents))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = (
    op1_ngram_jaccard_join, op2_url_filter, op3_suffix_array_dedup, op4_html_extraction, op5_benchmark_decontamination,
    op6_source_mixing, op7_warc_revisits, op8_brown_scores, op9_language_id, op10_nearest_neighbours,
    op11_fill_in_middle, op12_line_dedup, op13_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from tidewell.llm.oracles import ORACLES

    return dict(ORACLES)
