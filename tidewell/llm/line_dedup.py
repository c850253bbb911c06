"""Line dedup by sorted hashes: which lines of each document stay, as bitmaps.

Every line's key becomes a 64-bit hash. Rows of hash, document and position are
range-partitioned and sorted by all three, so that a key's documents stand in order
and a key that very many lines share spreads over several ranges. Each task streams
its range once. It decides the runs that lie inside it; of the runs at its two ends it
passes on the number of documents, and those counts, two a range, settle the runs that
cross ranges. What comes back is one compressed bitmap a document. Texts are neither
sorted nor grouped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidewell.llm.scratch import Scratch, column, packed, replaced

BLANK = b" \t\n\v\f\r"
BATCH_LINES = 500_000
DROP, OPEN, EDGE = 0, 1, 2  # a line to drop, a line of a run that crosses ranges, the counts of such a run


def line_key(line: bytes, min_chars: int) -> int:
    """A 64-bit hash of the line, stripped and A-Z lower-cased; 0 if it is shorter than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
        return 0
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True) or 1


def _keyed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Each text's lines as 8 bytes apiece."""
    for batch in batches:
        lines, keys = [], []
        for text in batch.column(2):
            found = [line_key(x, min_chars) for x in (text.as_py() or "").encode().split(b"\n")]
            lines.append(len(found))
            keys.append(np.array(found, np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.int32()), pa.array(keys, pa.binary())], ["id", "text_hash", "n_lines", "keys"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(h, id, text_hash, pos)``: a row for each line that has a key."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1]) // 8
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_LINES, "right")))
            part = batch.slice(i, j - i)
            h = np.frombuffer(b"".join(k.as_py() for k in part.column(2)), np.int64)
            row = np.repeat(np.arange(j - i), sizes[i:j])
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes[i:j]) - sizes[i:j], sizes[i:j])
            for first in range(0, len(h), BATCH_LINES):
                at = np.flatnonzero(h[first : first + BATCH_LINES]) + first
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), part.column(0).take(take), part.column(1).take(take), pa.array(pos[at].astype(np.int32))], ["h", "id", "text_hash", "pos"])
            i = j


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


class _Range:
    """One range of sorted lines, streamed. ``leading`` is its first run, which may go on from the range before."""

    names = ("part", "kind", "h", "id", "text_hash", "pos", "first", "docs", "last_id", "last_hash")

    def __init__(self, least: int, first_stays: bool) -> None:
        self.least, self.first_stays = least, first_stays
        self.h: int | None = None
        self.docs = 0
        self.leading = False
        self.begin: pa.RecordBatch | None = None  # the run's first line
        self.end: pa.RecordBatch | None = None  # and its last one so far
        self.held: list[pa.RecordBatch] = []  # lines of a run that hasn't met ``least`` documents
        self.seen = False
        self.out: list[pa.RecordBatch] = []

    def emit(self, kind: int, rows: pa.RecordBatch, first: bool = False) -> None:
        n = rows.num_rows
        last = self.end if kind == EDGE else rows
        flags = np.zeros(n, bool)
        flags[:1] = first
        made = [rows.column(0), pa.array(np.full(n, kind, np.int32)), *rows.columns[1:], pa.array(flags), pa.array(np.full(n, self.docs, np.int64)), last.column(2), last.column(3)]
        self.out.append(pa.RecordBatch.from_arrays(made, list(self.names)))

    def drop(self, rows: pa.RecordBatch, from_start: bool) -> None:
        self.emit(DROP, rows.slice(1) if from_start and self.first_stays else rows)

    def extend(self, rows: pa.RecordBatch, docs: int) -> None:
        """More lines of the run at hand, with so many documents not met in it before."""
        start = self.begin is None
        if start:
            self.begin = rows.slice(0, 1)
        before, self.docs = self.docs, self.docs + docs
        self.end = rows.slice(rows.num_rows - 1)
        if self.leading:
            self.emit(OPEN, rows, start)
        elif self.docs < self.least:
            self.held.append(rows)
        else:
            if before < self.least:
                for i, waiting in enumerate(self.held):
                    self.drop(waiting, i == 0)
                start = not self.held
                self.held = []
            self.drop(rows, start)

    def close(self, final: bool) -> None:
        if self.begin is not None and (final or self.leading):
            for i, waiting in enumerate(self.held):
                self.emit(OPEN, waiting, i == 0)
            self.emit(EDGE, self.begin)
        self.begin, self.docs, self.held = None, 0, []

    def open(self, h: int) -> None:
        self.h, self.leading = h, not self.seen
        self.seen = True

    def read(self, batch: pa.RecordBatch) -> None:
        h = batch.column(1).to_numpy()
        n = len(h)
        new_run, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_run[1:] = h[1:] != h[:-1]
        new_doc[1:] = new_run[1:] | _changes(batch.column(2)) | _changes(batch.column(3))
        if self.begin is not None and self.h == h[0]:
            new_run[0] = False
            new_doc[0] = any(self.end.column(c)[0].as_py() != batch.column(c)[0].as_py() for c in (2, 3))
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new_run)]))
        docs = np.add.reduceat(new_doc.astype(np.int64), cuts)
        cuts = np.append(cuts, n)
        if new_run[0]:
            self.close(False)
            self.open(int(h[0]))
        self.extend(batch.slice(0, int(cuts[1])), int(docs[0]))
        if len(docs) == 1:
            return
        self.close(False)
        # Runs that lie inside this batch.
        size = np.diff(cuts[1:-1])
        gone = np.repeat(docs[1:-1] >= self.least, size)
        if self.first_stays:
            gone[(cuts[1:-2] - cuts[1])] = False
        at = np.flatnonzero(gone) + int(cuts[1])
        if len(at):
            self.emit(DROP, batch.take(pa.array(at)))
        self.open(int(h[-1]))
        self.extend(batch.slice(int(cuts[-2])), int(docs[-1]))


def _judged(batches: Iterator[pa.RecordBatch], least: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Streams ``(part, h, id, text_hash, pos)``, sorted; see ``_Range``."""
    state = _Range(least, first_stays)
    for batch in batches:
        if batch.num_rows:
            state.read(batch)
        yield from state.out
        state.out = []
    state.close(True)
    yield from state.out


def _packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3)):
            bits = np.ones(n, bool)
            bits[gone.values.to_numpy()] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        dropped = pa.array(pc.list_value_length(batch.column(3)).cast(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), dropped, pa.array(keep, pa.binary())], ["id", "text_hash", "n_lines", "n_dropped", "keep"])


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(column(text), F.lit("")))


def line_keep_bitmaps(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, first_stays: bool = False) -> DataFrame:
    """``(<id>, text_hash, n_lines, n_dropped, keep)`` for every different document.

    A text's lines are parted by line feeds; a null or empty text is one empty line. A
    line's key is the line stripped of white space, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that ``min_docs`` documents hold lose their lines, all of
    them, or with ``first_stays`` all but the first by id, text hash and position (null
    ids first). ``keep`` has a bit for each line, high bits first, 1 for a line that
    stays, compressed by zlib; ``kept_lines`` applies it.

    A document is an id with a text, told apart by ``text_hash``: equal rows are one
    document and share one result row, one id with two texts is two. Keys and texts go
    by 64-bit hashes: n lines beside k keys to drop lose about n k / 2⁶⁴ wrongly. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    source = documents.select(column(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), column(text_col).alias("text"))
    own = [StructField("id", source.schema["id"].dataType), StructField("text_hash", LongType())]
    keyed = StructType([*own, StructField("n_lines", IntegerType()), StructField("keys", BinaryType())])
    texts = scratch.save(source.mapInArrow(lambda it: _keyed(it, min_chars), keyed), "keys")  # read by the ranges' sample, too
    line = StructType([StructField("h", LongType()), *own, StructField("pos", IntegerType())])
    order = ["h", "id", "text_hash", "pos"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = texts.select("id", "text_hash", "keys").mapInArrow(_lines, line)
    lines = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order)
    marked = StructType([
        StructField("part", IntegerType()), StructField("kind", IntegerType()), *line.fields, StructField("first", BooleanType()), StructField("docs", LongType()),
        StructField("last_id", own[0].dataType), StructField("last_hash", LongType()),
    ])
    judged = scratch.save(lines.mapInArrow(lambda it: _judged(it, min_docs, first_stays), marked), "judged")
    # Two rows a range at most: the counts of runs that cross ranges, a document at a border counted once.
    before = Window.partitionBy("h").orderBy("part")
    again = F.lag(F.lit(True), 1, False).over(before) & F.lag("last_id").over(before).eqNullSafe(F.col("id")) & F.lag("last_hash").over(before).eqNullSafe(F.col("text_hash"))
    edges = judged.where(F.col("kind") == EDGE).select("h", "part", (F.col("docs") - again.cast("int")).alias("docs"))
    crossing = edges.groupBy("h").agg(F.sum("docs").alias("all"), F.min("part").alias("from")).where(F.col("all") >= min_docs).select(F.col("h").alias("k"), "from")
    left = judged.where(F.col("kind") == OPEN).join(F.broadcast(crossing), F.col("h") == F.col("k"))
    if first_stays:
        left = left.where(~(F.col("first") & (F.col("part") == F.col("from"))))
    gone = judged.where(F.col("kind") == DROP).select("id", "text_hash", "pos").union(left.select("id", "text_hash", "pos"))
    rows = texts.select("id", "text_hash", "n_lines", F.lit(None).cast("int").alias("pos")).union(gone.select("id", "text_hash", F.lit(None).cast("int"), "pos"))
    found = rows.groupBy("id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    bitmaps = StructType([*own, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("keep", BinaryType())])
    return found.mapInArrow(_packed_bits, bitmaps).withColumnRenamed("id", id_col)


def kept_text(text: str, keep: bytes) -> str:
    """The lines of a text whose bit is set, joined by line feeds."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, stays in zip(lines, bits) if stays)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if k is None or t is None else kept_text(t, k) for t, k in ((t.as_py(), k.as_py()) for t, k in zip(batch.column(1), batch.column(2)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3), batch.column(4)], ["rest", "text", "n_lines", "n_dropped"])


def kept_lines(documents: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the lines that their ``bitmaps`` keep, and ``n_lines, n_dropped``.

    Columns stay, except that the new names replace others of theirs. Rows without a
    bitmap keep their text and have null counts; a null text stays null.
    """
    new = ("n_lines", "n_dropped")
    docs = documents.select(packed(documents, text_col, *new), column(id_col).alias("i"), _text_hash(text_col).alias("h"), column(text_col).alias("text"))
    which = bitmaps.select(column(id_col).alias("_i"), F.col("text_hash").alias("_h"), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    met = docs.join(which, F.col("i").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left").select("rest", "text", "keep", "n_lines", "n_dropped")
    schema = StructType([met.schema["rest"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    done = met.mapInArrow(_apply, schema)
    return done.select(*replaced(documents, text_col, F.col("text"), *new), *new)
