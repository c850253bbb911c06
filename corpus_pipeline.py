"""A corpus pipeline: five stages over ``documents``, each written and read again.

Language ID, near duplicates, repeated passages, benchmark passages, mixing. All
stages but the last return the columns of ``documents``. Stages that send texts to
Python limit the bytes of the session's Arrow batches, where it has no limit yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.decontaminate import find_contamination
from tidewell.llm.jaccard import ngram_jaccard_join
from tidewell.llm.langid import identify_language
from tidewell.llm.mixing import mix_sources
from tidewell.llm.scratch import Scratch, byte_batches, column, packed, unpacked
from tidewell.llm.suffixes import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language ID rejects: no letters, or like no learnt language.

    So null, empty and letterless texts go. Repeated rows are judged each and alike;
    the models are learnt from the table's own texts with a language, each once.
    Null ids and sources change nothing. An empty table stays empty; without any
    language all documents are rejected. Extra columns stay, whatever their names.
    """
    byte_batches(spark)
    rows = docs.select(packed(docs), F.col("text").alias("text"), F.col("lang").alias("lang"))
    return identify_language(rows, rows).where("not rejected").select(*unpacked(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by 5-word-shingle links of 0.75 or more, one stays: the smallest id, then the smallest text hash.

    Documents are told apart by id and text, so one id may stay with one text and go
    with another. Of rows equal in id and text any one stays. Null ids come last in
    their group. Documents without words are tied with nothing and stay, repeated or
    not. An empty table stays empty; extra columns stay, whatever their names.
    """
    byte_batches(spark)
    scratch = Scratch(spark, "near-duplicates")
    found = ngram_jaccard_join(docs).where("root is not null").groupBy("doc_id", "text_hash").agg(F.first("root").alias("root"), F.count("*").alias("n"))
    found = scratch.save(found, "documents")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("b")).select(F.col("b.doc_id").alias("i"), F.col("b.text_hash").alias("t"))
    best = scratch.save(best, "best")
    gone = found.join(best, found.doc_id.eqNullSafe(best.i) & (found.text_hash == best.t), "left_anti").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))

    def of(keys: DataFrame) -> Column:
        return docs["doc_id"].cast("bigint").eqNullSafe(keys["i"]) & (F.xxhash64(docs["text"]) == keys["t"])

    kept = docs.join(gone, of(gone), "left_anti")
    repeated = found.where("n > 1").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, of(repeated), "left_anti")
    return single.union(kept.join(repeated, of(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of 50 words or more are cut; n_chars follows.

    First occurrences are those of the smallest id, null ids first, then text hash
    and position. Documents of which no word is left go; those without words stay.
    Rows equal in id and text are one document, cut alike. An empty table stays
    empty; extra columns stay, whatever their names.
    """
    byte_batches(spark)
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(column, docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    Null and wordless texts hold nothing and stay, as do repeated rows of clean
    texts and all extra columns, whatever their names. An empty table stays empty.
    """
    byte_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(packed(docs), F.col("text").alias("text"))
    return find_contamination(rows, benchmark).where(F.size("hit_words") == 0).select(*unpacked(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, sources weighing 1, 2, 3, repeating.

    Null and wordless texts have size 0 and give nothing; a null source is a source
    of its own, last; repeated rows are rows of their own. An empty table gives an
    empty result; extra columns are ignored.
    """
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]

#: Language models and similarity components have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written as Parquet and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
