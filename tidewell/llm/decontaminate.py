"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are runs of ``window`` item words. Symbols are words, blocks are pairs
of words. For every block the shift table says how far the search may move on: a
block that no pattern holds lets it skip a whole window less one word. Only where
the shift is zero is the bucket of the patterns that end in this block looked up,
narrowed by their first block; the words are then compared directly.

Texts are cut into lanes of window ends, and all lanes of a slice move on at once,
each by its own shifts, so a step of the search is a few vector operations.

The pattern tables go to the executors with the task. Their size is bounded:
patterns are taken ``block_patterns`` at a time, each in a job of its own that
keeps its finds only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewell.llm.scratch import Scratch, column, packed, unpacked
from tidewell.llm.words import ALNUM, U, Slice, mix, slices

SHIFT_BITS = (16, 24)  # of the table's size, at least and at most
LANE = 128  # window ends that one lane of the search covers


@dataclass
class Patterns:
    """Tables for the patterns of one length, sorted by bucket."""

    length: int
    bits: int
    shift: np.ndarray  # by block slot: words to move on, 0 where a pattern may end
    bucket: np.ndarray  # sorted hashes of last and first block
    words: list[bytes]  # the words of each, by one space
    items: list[list[int]]  # of each, the items that have it


def _block(words: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Hash of the block that ends at word ``end``: two words, or the word alone if patterns are of one."""
    value = words[end]
    return mix(value + mix(words[end - 1] + U(7))) if length > 1 else mix(value)


def _bucket(words: np.ndarray, end: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hash of a window's last and first block."""
    return mix(last ^ mix(_block(words, end - length + min(2, length), length) + U(3)))


def build(items: list[tuple[int | None, str]]) -> list[Patterns]:
    """Pattern tables from (item id, words by one space) of every item window."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for item, run in items:
        raw = run.encode()
        found = by_length.setdefault(raw.count(b" ") + 1, {}).setdefault(raw, [])
        if item is not None:
            found.append(item)
    out = []
    for length, runs in sorted(by_length.items()):
        texts = list(runs)
        bits = min(SHIFT_BITS[1], max(SHIFT_BITS[0], int(8 * length * len(texts)).bit_length()))
        most = max(1, length - 1)
        shift, bucket = np.full(1 << bits, most, np.int32), []
        for part in slices(pa.array([t.decode() for t in texts]), ALNUM, lower=False):
            first = part.at[:-1]
            for k in range(min(1, length - 1), length):
                block = _block(part.hash, first + k, length)
                np.minimum.at(shift, (block >> U(64 - bits)).astype(np.int64), length - 1 - k)
            bucket.append(_bucket(part.hash, first + length - 1, block, length))
        bucket = np.concatenate(bucket)
        order = np.argsort(bucket)
        out.append(Patterns(length, bits, shift, bucket[order], [texts[i] for i in order], [sorted(set(runs[texts[i]])) for i in order]))
    return out


def possible_ends(part: Slice, t: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a window may end, and their blocks: all others are skipped by shifts."""
    first, last = part.at[:-1] + t.length - 1, part.at[1:]  # of each text, its window ends
    lanes = np.maximum(0, -(-(last - first) // LANE))
    text = np.repeat(np.arange(part.n), lanes)
    start = first[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(start + LANE, last[text])
    ends, blocks = [], []
    while len(start):
        block = _block(part.hash, start, t.length)
        shift = t.shift[(block >> U(64 - t.bits)).astype(np.int64)]
        zero = shift == 0
        ends.append(start[zero])
        blocks.append(block[zero])
        start = start + np.maximum(shift, 1)
        on = start < stop
        start, stop = start[on], stop[on]
    return (np.concatenate(ends), np.concatenate(blocks)) if ends else (np.zeros(0, np.int64), np.zeros(0, U))


def occurrences(part: Slice, tables: list[Patterns]) -> Iterator[tuple[int, int, list[int]]]:
    """First word, length and items of every confirmed occurrence in a slice."""
    for t in tables:
        end, block = possible_ends(part, t)
        if not len(end):
            continue
        bucket = _bucket(part.hash, end, block, t.length)
        left = np.searchsorted(t.bucket, bucket, "left")
        some = np.flatnonzero(t.bucket[np.minimum(left, len(t.bucket) - 1)] == bucket)
        right = np.searchsorted(t.bucket, bucket[some], "right")
        for i, upto in zip(some.tolist(), right.tolist()):
            w = int(end[i]) - t.length + 1
            here = b" ".join(part.data[part.start[k] : part.end[k]].tobytes() for k in range(w, w + t.length))
            for j in range(int(left[i]), upto):
                if t.words[j] == here:
                    yield w, t.length, t.items[j]


def _scan(batches: Iterator[pa.RecordBatch], tables: list[Patterns], every: bool = True) -> Iterator[pa.RecordBatch]:
    """The columns but the last, which is the text, and its finds; unless ``every``, only texts with finds."""
    for batch in batches:
        hits: list[list[int]] = [[] for _ in range(batch.num_rows)]
        items: list[set[int]] = [set() for _ in range(batch.num_rows)]
        counts = np.zeros(batch.num_rows, np.int64)
        for part in slices(batch.column(batch.num_columns - 1), ALNUM):
            counts[part.first : part.first + part.n] = np.diff(part.at)
            hit = np.zeros(len(part.hash) + 1, np.int64)
            for w, length, found in occurrences(part, tables):
                hit[w] += 1
                hit[w + length] -= 1
                items[part.first + int(np.searchsorted(part.at, w, "right")) - 1].update(found)
            for k in np.flatnonzero(np.cumsum(hit[:-1])).tolist():
                row = int(np.searchsorted(part.at, k, "right")) - 1
                hits[part.first + row].append(k - int(part.at[row]))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        out = pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], [*batch.schema.names[:-1], "n_words", "hit_words", "items"])
        yield out if every else out.filter(pa.array([bool(h) for h in hits], pa.bool_()))


def normalised_words(text: Column) -> Column:
    """Array of words: A-Z lower-cased runs of digits, a-z and non-ASCII characters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, run)``: each item's runs of ``window`` words; all its words if it has fewer."""
    words = benchmark.select(F.col(id_col).cast("bigint").alias("item"), normalised_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    run = f"transform(sequence(1, greatest(1, size(w) - {window} + 1)), i -> array_join(slice(w, i, {window}), ' '))"
    return words.select("item", F.explode(F.expr(run)).alias("run")).distinct()


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_patterns: int = 200_000
) -> DataFrame:
    """``documents`` without ``text_col``, with ``n_words, hit_words, items``.

    ``hit_words`` holds, in order, the positions of words inside any occurrence of
    an item window, ``items`` the distinct ids of the items that occur, sorted.
    Null or wordless text: no words, no hits. A null item text has no windows; an
    item with a null id marks words but is in no list. Repeated rows repeat in the
    result; an empty benchmark hits nothing. Columns of ``documents`` that bear the
    new names are replaced.

    A benchmark of more than ``block_patterns`` windows is searched for in several
    jobs; finds meet their documents again by the text's SHA-256.
    """
    spark = documents.sparkSession
    runs = item_windows(benchmark, item_id, item_text, window)
    new = [StructField("n_words", LongType()), StructField("hit_words", ArrayType(LongType())), StructField("items", ArrayType(LongType()))]
    apart = (text_col, *(f.name for f in new))
    rows = documents.select(packed(documents, *apart), column(text_col).alias("text"))
    rest = unpacked(documents, *apart)
    blocks = max(1, -(-runs.count() // block_patterns))
    if blocks == 1:
        tables = build([(r.item, r.run) for r in runs.collect()])
        found = rows.mapInArrow(lambda it: _scan(it, tables), StructType([rows.schema["rest"], *new]))
        return found.select(*rest, "n_words", "hit_words", "items")
    scratch = Scratch(spark, "decontaminate")
    keyed = scratch.save(runs.withColumn("block", F.pmod(F.xxhash64("run"), F.lit(blocks))), "runs")
    name = F.sha2(F.col("text").cast("binary"), 256).alias("name")
    finds = None
    for b in range(blocks):
        tables = build([(r.item, r.run) for r in keyed.where(F.col("block") == b).collect()])
        found = rows.select(name, "text").mapInArrow(lambda it, t=tables: _scan(it, t, every=False), StructType([StructField("name", StringType()), *new]))
        found = scratch.save(found.drop("n_words").dropDuplicates(["name"]), f"block{b}")
        finds = found if finds is None else finds.union(found)
    both = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "items")]
    finds = finds.groupBy("name").agg(*both).withColumnsRenamed({"hit_words": "hits", "items": "found"})
    counted = rows.select("rest", name, "text").mapInArrow(lambda it: _scan(it, []), StructType([rows.schema["rest"], StructField("name", StringType()), *new]))
    none = F.array().cast("array<bigint>")
    return counted.join(finds, "name", "left").select(*rest, "n_words", F.coalesce("hits", none).alias("hit_words"), F.coalesce("found", none).alias("items"))
