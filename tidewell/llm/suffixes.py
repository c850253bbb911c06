"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are kept: every run of ``least`` words has an
anchor, the smallest hash of a k-gram among its first starts, chosen by content
alone, so equal runs have equal anchors. The consecutive runs of one anchor make a
segment, which is all that a match of such a run can cover. A suffix has a head,
the hash of the words from the anchor on that every run of it contains. All
are sorted by head and segment once, and those with a neighbour of equal head go
on: no other suffix can match the rest. Suffixes with equal head and segment match
over all of it and make a class, for which its first member stands.

The classes are sorted by head and segment, and those with a neighbour of equal
head go on as suffixes proper: they are sorted by head and by their words after it,
and the longest common prefix with either neighbour says how far to the right any
other suffix can match. The rest is sorted by head and by the words before the
anchor, backwards, and the neighbours say how far to the left. What runs lie
within both extensions are named by hash, and equal ones are repeated passages.
Each sort is by ranges, its last keys being the place, so that equal suffixes
spread over tasks; at the edges of a range an extension is taken to be full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidewell.llm.scratch import Scratch, column, packed, replaced
from tidewell.llm.words import _BASE, _BASE_INV, U, Slice, _powers, buffers, mix, signed, slices

GRAM = 8


class Runs:
    """Hashes of any run of words of a slice, from prefix sums."""

    def __init__(self, part: Slice) -> None:
        n = len(part.hash)
        self.down = _powers(_BASE_INV, n + 1)
        self.total = np.zeros(n + 1, U)
        np.cumsum(mix(part.hash) * _powers(_BASE, n + 1)[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def anchored(part: Slice, runs: Runs, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of the slice: its word, its first run's word and the number of its runs."""
    starts = least - GRAM + 1 - _head(least)  # starts of k-grams that compete for the anchor
    n = len(part.hash)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    first = np.arange(n - least + 1)
    text = np.repeat(np.arange(part.n), np.diff(part.at))
    inside = text[first] == text[first + least - 1]
    gram = runs(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = _first_lowest(gram, starts)[: n - least + 1]
    first = first[inside]
    anchor = low[inside]
    if not len(first):
        return none, none, none
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    new = np.flatnonzero(new)
    return anchor[new], first[new], np.diff(np.append(new, len(first)))


def _first_lowest(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the lowest, the first of equals, by doubling."""
    value, place, done = x, np.arange(len(x)), 1
    while done < width:
        step = min(done, width - done)
        left, right = value[: len(value) - step], value[step:]
        place = np.where(left <= right, place[: len(place) - step], place[step:])
        value = np.minimum(left, right)
        done += step
    return place


def _head(least: int) -> int:
    """Words from the anchor on that heads hold beyond its k-gram."""
    return least // 5


def _suffixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``id, t, pos, n, a, head, segment``: first run, number of runs, words from the first run to the anchor."""
    width = GRAM + _head(least)
    for batch in batches:
        for part in slices(batch.column(2)):
            runs = Runs(part)
            anchor, first, count = anchored(part, runs, least)
            if not len(anchor):
                continue
            text = np.searchsorted(part.at, first, "right") - 1
            row = pa.array(part.first + text)
            head = runs(anchor, anchor + width)
            segment = runs(first, first + count - 1 + least)
            numbers = [pa.array(x.astype(np.int32)) for x in (first - part.at[text], count, anchor - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *numbers, pa.array(signed(head)), pa.array(signed(segment))], ["id", "t", "pos", "n", "a", "head", "segment"])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit word hashes, a row for each value, and their numbers."""
    off, raw = buffers(column)
    size = np.diff(off) // 4
    out = np.zeros((len(size), int(size.max(initial=0))), np.uint32)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = raw.view(">u4")
    return out, size


def common(column: pa.Array) -> np.ndarray:
    """Words that each value and the next have in common from the start on, or more where hashes of 32 bits agree."""
    words, size = _words(column)
    differ = words[1:] != words[:-1]
    least = np.minimum(size[1:], size[:-1])
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), least), least) if words.shape[1] else least


def neighbours(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows with the larger of what ``compare`` finds between each and its two neighbours; ``most`` at the ends."""
    held, before = None, most
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        found = compare(rows)
        upper = np.concatenate([[before], found])
        if rows.num_rows > 1:
            yield rows.slice(0, rows.num_rows - 1), np.maximum(upper[:-1], found)
        held, before = rows.slice(rows.num_rows - 1), int(upper[-1])
    if held is not None:
        yield held, np.array([most])


def _same_head(rows: pa.RecordBatch) -> np.ndarray:
    head = rows.column("head").to_numpy()
    return (head[1:] == head[:-1]).astype(np.int64)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes or classes in order of head and segment, those with a neighbour of equal head, and those at the ends."""
    for rows, same in neighbours(batches, _same_head, 1):
        yield rows.filter(pa.array(same > 0))


def _binary(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """``size`` values from each start on, as one binary value each."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat = values[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds * flat.itemsize), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The listed segments with the names of their runs, and their words after the head and, backwards, before the anchor."""
    head_words = GRAM + _head(least)
    for batch in batches:
        wanted = batch.column(3)
        for part in slices(batch.column(2)):
            listed = wanted.slice(part.first, part.n)
            text = np.repeat(np.arange(part.n), np.asarray(listed.value_lengths()))
            pos, n, a, head = (listed.flatten().field(i) for i in range(4))
            first, count, left = pos.to_numpy() + part.at[text], n.to_numpy(), a.to_numpy()
            anchor = first + left
            short = (part.hash >> U(32)).astype(">u4")
            start = np.arange(max(0, len(part.hash) - least + 1))
            runs = Runs(part)(start, start + least)
            row = pa.array(part.first + text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pos, n, a, head, _binary(short, anchor + head_words, count - 1 + least - left - head_words), _binary(short[::-1], len(short) - anchor, left), _binary(runs, first, count)],
                ["id", "t", "pos", "n", "a", "head", "right", "left", "runs"],
            )


def _matched(side: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Compares suffixes in order of head and ``side``: words in common on that side, -1 if heads differ."""
    return lambda rows: np.where(_same_head(rows) > 0, common(rows.column(side)), -1)


def _rightwards(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by their words, those that another can match to the right over some run, with the number of such runs."""
    head_words = GRAM + _head(least)
    for rows, most in neighbours(batches, _matched("right"), 1 << 30):
        n, a = (rows.column(x).to_numpy() for x in "na")
        upto = np.where(most < 0, 0, np.minimum(n, a - least + head_words + most + 1))
        kept = [x for x in rows.schema.names if x not in ("right", "n")]
        yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in kept), pa.array(upto.astype(np.int32))], [*kept, "upto"]).filter(pa.array(upto > 0))


def _leftwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by head and words before them, the runs within both extensions."""
    for rows, most in neighbours(batches, _matched("left"), 1 << 30):
        a, upto = (rows.column(x).to_numpy().astype(np.int64) for x in ("a", "upto"))
        low = np.where(most < 0, upto, np.maximum(0, a - most))
        count = np.maximum(0, upto - low)
        row = np.repeat(np.arange(len(count)), count)
        if not len(row):
            continue
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        off, raw = buffers(rows.column("runs"))
        run = raw.view(np.int64)[off[row] // 8 + k]
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([rows.column("id").take(at), rows.column("t").take(at), pa.array((rows.column("pos").to_numpy()[row] + k).astype(np.int32)), rows.column("pos").take(at), pa.array(run)], ["id", "t", "pos", "seg", "run"])


def repeated_passages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """``(id, t, spans, first_ids)`` for each text with words of a passage that occurs twice or more.

    A passage is a run of ``least`` words or more (words: runs of non-blank bytes,
    A-Z lower-cased). ``spans`` are ``(start, end, removed)`` in words, not merged;
    ``removed`` is false for first occurrences, in order of id, text hash and
    position; ``first_ids`` are the ids that hold the first occurrences of what is
    removed. ``t`` is xxhash64 of the text.

    Null or short texts have no passage. Null ids come first. Rows equal in id and
    text are one document. An empty table gives an empty result; extra columns are
    ignored. Runs are compared by 64-bit hashes.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = documents.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.mapInArrow(lambda it: _suffixes(it, least), "id bigint, t bigint, pos int, n int, a int, head bigint, segment bigint")
    rows = scratch.save(rows, "suffixes")
    place_names = ("id", "t", "pos")
    place = F.struct(*place_names)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def in_order(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)

    # The only shuffle that all suffixes take part in. What it keeps is in order, so that a class is met whole or nearly so.
    rows = scratch.save(in_order(rows, "head", "segment", *place_names).mapInArrow(_crowded, rows.schema), "met")
    scratch.drop("suffixes")
    classes = rows.groupBy("head", "segment").agg(F.min(F.struct("id", "t", "pos", "n", "a")).alias("first"), F.max(place).alias("last"))
    classes = classes.select("head", "segment", "first", (F.struct("first.id", "first.t", "first.pos") != F.col("last")).alias("again"))
    classes = scratch.save(classes, "classes")

    crowded = in_order(classes.select("head", "segment", "first.*"), "head", "segment")
    crowded = crowded.select("id", "t", "pos", "n", "a", "head").mapInArrow(_crowded, "id bigint, t bigint, pos int, n int, a int, head bigint")
    extend = crowded.groupBy("id", "t").agg(F.collect_list(F.struct("pos", "n", "a", "head")).alias("segments")).withColumnsRenamed({"id": "i", "t": "u"})
    found = texts.join(extend, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u"))).select("id", "t", "text", "segments")
    suffix = "id bigint, t bigint, pos int, n int, a int, head bigint, right binary, left binary, runs binary"
    found = found.mapInArrow(lambda it: _contexts(it, least), suffix)
    found = in_order(found, "head", "right", *place_names).mapInArrow(lambda it: _rightwards(it, least), "id bigint, t bigint, pos int, a int, head bigint, left binary, runs binary, upto int")
    found = in_order(found, "head", "left", *place_names).mapInArrow(_leftwards, "id bigint, t bigint, pos int, seg int, run bigint")
    found = scratch.save(found, "runs")
    met = found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("run", "first")
    of_runs = found.join(met, "run").select("id", "t", F.col("pos").alias("start"), (F.col("pos") + least).alias("end"), (place != F.col("first")).alias("removed"), F.array_compact(F.array("first.id")).alias("ids"), "seg")
    # What a class repeats may occur before it, in another class: its members' first occurrences are then those of its first member.
    earlier = of_runs.where("removed").groupBy(F.col("id").alias("i"), F.col("t").alias("u"), "seg").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.size(F.collect_set("start")).alias("gone"))
    copied = classes.where("again").select("head", "segment", "first")
    copied = copied.join(earlier, F.col("first.id").eqNullSafe(F.col("i")) & (F.col("first.t") == F.col("u")) & (F.col("first.pos") == F.col("seg")), "left")
    own = F.when(F.coalesce("gone", F.lit(0)) < F.col("first.n"), F.array_compact(F.array("first.id"))).otherwise(F.array().cast("array<bigint>"))
    copied = copied.select("head", "segment", "first", F.array_union(own, F.coalesce("ids", F.array().cast("array<bigint>"))).alias("ids"))
    of_class = rows.join(copied, ["head", "segment"]).select(
        "id", "t", F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1 + least).alias("end"), (place != F.struct("first.id", "first.t", "first.pos")).alias("removed"), "ids"
    )
    spans = of_class.union(of_runs.drop("seg")).groupBy("id", "t").agg(
        F.collect_list(F.struct("start", "end", "removed")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("removed"), F.col("ids")))))).alias("first_ids")
    )
    spans = scratch.save(spans, "spans")
    scratch.drop("met", "classes", "runs")
    return spans


def united(spans: pa.Array, removed_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of each row's spans as disjoint ones in order: row, start, end."""
    size = np.asarray(spans.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(size)), size)
    start, end, removed = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
    if removed_only:
        row, start, end = row[removed], start[removed], end[removed]
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return row, start, end
    shift = row * (end.max() + 1)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], start[new], reach[last] - shift[last]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for only in (False, True):
            row, start, end = united(batch.column(1), only)
            sums.append(pa.array(np.bincount(row, end - start, batch.num_rows).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *sums, batch.column(2)], ["id", "n_repeated", "n_removed", "first_ids"])


def passage_report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """``(<id>, n_repeated, n_removed, first_ids)``: one row per text of ``repeated_passages``, words counted once."""
    spans = repeated_passages(documents, id_col=id_col, text_col=text_col, least=least).select("id", "spans", "first_ids")
    counted = spans.mapInArrow(_counted, "id bigint, n_repeated bigint, n_removed bigint, first_ids array<bigint>")
    return counted.withColumnRenamed("id", id_col)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (other columns, spans, text): texts without their removed words; the blanks after a removed word go with it."""
    for batch in batches:
        row, first, last = united(batch.column(1), True)
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        texts, out = batch.column(2), []
        for part in slices(texts, lower=False):
            for i in range(part.n):
                mine = slice(bounds[part.first + i], bounds[part.first + i + 1])
                if mine.start == mine.stop:
                    out.append(texts[part.first + i].as_py())
                    continue
                lo, hi = part.bounds[i], part.bounds[i + 1]
                start = part.start[part.at[i] : part.at[i + 1]]
                kept, at = [], lo
                for s, e in zip(first[mine], last[mine]):
                    kept.append(part.data[at : start[s]])
                    at = start[e] if e < len(start) else hi
                kept.append(part.data[at:hi])
                out.append(np.concatenate(kept).tobytes().decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds) > 0), pa.array(out, pa.string())], ["rest", "cut", "text"])


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """``documents`` without the later occurrences of repeated passages, and without texts of which no word is left.

    First occurrences, in order of id, text hash and position, stay. Null, empty and
    short texts stay as they are, as do all columns but ``text_col``, whatever their
    names. Rows equal in id and text count as one document: each is cut alike and
    none is another's copy. An empty table gives an empty result.
    """
    spans = repeated_passages(documents, id_col=id_col, text_col=text_col, least=least)
    spans = spans.select(F.col("id").alias("_span_id"), F.col("t").alias("_span_t"), F.col("spans").alias("_span_list"))
    rows = documents.select(packed(documents, text_col), column(id_col).cast("bigint").alias("id"), column(text_col).alias("text"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("_span_id")) & (F.xxhash64("text") == F.col("_span_t")), "left")
    done = joined.select("rest", F.col("_span_list").alias("spans"), "text").mapInArrow(_cut, StructType([rows.schema["rest"], StructField("cut", BooleanType()), StructField("text", StringType())]))
    kept = done.where("not cut or text rlike '[^\\x20\\x09-\\x0D]'")
    return kept.select(*replaced(documents, text_col, F.col("text")))
