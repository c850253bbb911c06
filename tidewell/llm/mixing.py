"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document has a virtual finish time: the words of its source up to
and including it, in a shuffled order, divided by the source's target. All copies
are sorted by that time into ranges, their words are summed in that order, and the
mix is cut where the total budget, all words of the corpus, is used up.

The copy of a source that is being served at virtual time one, when every source
has had its target, is split there. So a source misses its target by fewer words
than there are sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.ranges import running
from tidewell.llm.scratch import Scratch


def word_count(text: Column) -> Column:
    """Runs of bytes other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def _in_order(source: Column) -> list[Column]:
    """Sources by code point, null last."""
    return [source.isNull(), source]


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Column | None = None, repeats: int = 3) -> DataFrame:
    """``(source, source_size, source_start, weight, target)`` from one row ``(source, source_size)`` per source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, unless
    ``weights`` says otherwise; ``source_start`` is the words of those before. A
    target is the source's share of all words by weight, at most ``repeats`` times
    its size; what is cut off is shared again by weight: with the sources in order
    of size by weight, those before a point are at their limit, the others share
    the rest evenly by weight.
    """
    ranked = running(sizes, _in_order(F.col("source")), {"nth": F.lit(1), "through": F.col("source_size")}, scratch, "ranked")
    weight = weights if weights is not None else ((F.col("nth") - 1) % 3 + 1).cast("double")
    weighed = ranked.select("source", "source_size", (F.col("through") - F.col("source_size")).alias("source_start"), weight.alias("weight"))
    weighed = weighed.withColumn("limit", F.col("source_size") * repeats).withColumn("reach", F.col("limit") / F.col("weight"))
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    rising = running(weighed, [F.col("reach"), *_in_order(F.col("source"))], {"limits": F.col("limit"), "weights": F.col("weight")}, scratch, "rising")
    left = F.lit(total.words) - (F.col("limits") - F.col("limit"))
    level = (left / (F.lit(total.weights) - (F.col("weights") - F.col("weight")))).alias("level")
    share = rising.select("reach", level).where("level <= reach").agg(F.max("level")).first()[0]
    return weighed.select("source", "source_size", "source_start", "weight", F.least(F.col("limit").cast("double"), F.lit(share) * F.col("weight")).alias("target"))


def _placed(documents: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, repeats: int) -> DataFrame:
    """Each document with its row number, its source's figures and ``upto``, the source's words up to its end."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    docs = scratch.save(docs, "sizes")  # texts are read once, not for the sort's sample too
    docs = docs.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    docs = running(docs, [*_in_order(F.col("source")), F.col("key"), F.col("id"), F.col("size")], {"row": F.lit(1), "through": F.col("size")}, scratch, "documents").drop("key")
    sizes = scratch.save(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes, scratch, repeats=repeats).withColumnRenamed("source", "s")
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return scratch.save(joined.withColumn("upto", F.col("through") - F.col("source_start")).drop("through", "source_start", "weight"), "placed")


def _schedule(placed: DataFrame, scratch: Scratch, repeats: int) -> DataFrame:
    """``(row, id, source, copy, finish, words, at)``: the pieces of the mix and where each begins in it."""
    start = F.col("upto") - F.col("size") + F.col("copy") * F.col("source_size")
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", start)
    copies = copies.where("start < target").withColumn("served", F.expr("least(size, greatest(0, floor(target) - start))"))
    finish = (F.col("start") + F.col("size")) / F.col("target")
    piece = F.explode(F.array(
        F.struct(F.when(F.col("served") == F.col("size"), finish).otherwise(F.lit(1.0)).alias("finish"), F.col("served").alias("words")),
        F.struct(finish.alias("finish"), (F.col("size") - F.col("served")).alias("words")),
    ))
    pieces = copies.select("row", "id", "source", "copy", "start", piece.alias("piece")).select("row", "id", "source", "copy", "start", "piece.*").where("words > 0")
    pieces = running(pieces, [F.col("finish"), *_in_order(F.col("source")), F.col("start")], {"upto": F.col("words")}, scratch, "schedule")
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = pieces.withColumn("at", F.col("upto") - F.col("words")).where(F.col("at") < budget)
    return cut.withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("at"))).drop("upto", "start")


def mix_schedule(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3) -> DataFrame:
    """``(<id>, source, copy, finish, words, at)``: the mix itself, one row for each piece that it takes.

    ``copy`` counts from 0; ``at`` is the number of words before the piece, so that
    pieces in order of ``at`` follow one another without a gap.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    pieces = _schedule(_placed(documents, scratch, id_col, text_col, source_col, repeats), scratch, repeats)
    return pieces.select(F.col("id").alias(id_col), "source", "copy", "finish", "words", "at")


def mix_sources(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3) -> DataFrame:
    """``(<id>, source, size, source_size, target, taken)`` for every document.

    ``taken`` is the document's words in the mix: up to ``repeats`` copies, the last
    of a source cut where the mix ends. A source's order is by md5 of the id, so
    reruns agree. The mix holds as many words as the corpus.

    Null or wordless text: size 0, nothing taken. Null source: a source of its own,
    last. Null ids sort by the md5 of an empty text; rows equal in id and size are
    told apart by nothing and so are interchangeable. An empty table gives an empty
    result; extra columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    placed = _placed(documents, scratch, id_col, text_col, source_col, repeats)
    taken = _schedule(placed, scratch, repeats).groupBy("row").agg(F.sum("words").alias("taken")).withColumnRenamed("row", "r")
    out = placed.join(taken, F.col("row") == F.col("r"), "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
