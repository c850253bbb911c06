"""Fill-in-middle transformation of texts for training infilling models.

A text is cut at two unit boundaries into prefix, middle and suffix, which are then
put in another order behind sentinels. The matcher reads a text twice and stores no
units: the first pass counts them, the second advances one lazy match iterator to the
lower and then to the higher rank and notes where each ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.scratch import column, packed, unpacked

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
BATCH_CHARS = 4_000_000

Row = tuple[str, int, str, int | None, int | None]


def _advance(units: Iterator[re.Match], steps: int, at: int) -> int:
    """The end of the unit so many steps on, or ``at`` for none."""
    for unit in islice(units, steps):
        at = unit.end()
    return at


def cut_points(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Code points up to the end of the ``low``-th and of the ``high``-th unit (0 for none)."""
    units = unit.finditer(text)
    first = _advance(units, low, 0)
    return first, _advance(units, high - low, first)


def draws(name: str, seed: int) -> list[int]:
    """Four numbers below 2³² that depend on seed and name alone."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, name: str, unit: re.Pattern, seed: int, rate: int, spm: int, sentinels: Sequence[str]) -> Row:
    """``(output, units, form, prefix length, middle length)`` of one text."""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = draws(name, seed)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return text, n, "plain", None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_points(text, unit, low, high)
    p, s, m = sentinels
    if h4 % 100 < spm:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", n, "spm", a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", n, "psm", a, b - a


def _transform(batches: Iterator[pa.RecordBatch], unit: str, seed: int, rate: int, spm: int, sentinels: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Output batches of a bounded number of characters, or of one text."""
    pattern = re.compile(unit)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def out(batch: pa.RecordBatch, first: int, rows: list[Row]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *columns], ["rest", "output", "n", "form", "prefix_chars", "middle_chars"])

    for batch in batches:
        first, rows, held = 0, [], 0
        for i in range(batch.num_rows):
            rows.append(transformed(batch.column(2)[i].as_py() or "", batch.column(1)[i].as_py() or "", pattern, seed, rate, spm, sentinels))
            held += len(rows[-1][0])
            if held > BATCH_CHARS:
                yield out(batch, first, rows)
                first, rows, held = i + 1, [], 0
        if rows:
            yield out(batch, first, rows)


def check_sentinels(sentinels: Sequence[str]) -> None:
    """ValueError unless an output can be taken apart again: no sentinel in another, none's end the start of one."""
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels are needed, none of them empty")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if i != j and a in b or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"sentinels {a} and {b} overlap")


def fill_in_middle(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """``documents`` without ``text_col``, with ``output, n, form, prefix_chars, middle_chars``.

    ``unit`` is a regular expression whose matches, left to right, are the units;
    what lies between two of them goes with the later one, what follows the last
    with the suffix. Two ranks drawn by sha256 of seed and id give the cuts.
    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the
    suffix first. Form ``plain`` (the text itself, no lengths): empty texts, texts
    that hold a sentinel, and those not drawn. Lengths count code points.

    A null text counts as empty, a null id as an empty one. Rows with one id share
    their draws, equal rows come out equal; an empty table gives an empty result.
    Other columns stay, except ones that bear a new name. Nothing is shuffled.
    """
    check_sentinels(sentinels)
    new = ("output", "n", "form", "prefix_chars", "middle_chars")
    rows = documents.select(packed(documents, text_col, *new), column(id_col).cast("string").alias("name"), column(text_col).alias("text"))
    kinds = (StringType(), LongType(), StringType(), LongType(), LongType())
    schema = StructType([rows.schema["rest"], *(StructField(n, k) for n, k in zip(new, kinds))])
    marks = tuple(sentinels)
    return rows.mapInArrow(lambda it: _transform(it, unit, seed, rate, spm, marks), schema).select(*unpacked(documents, text_col, *new), *new)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from which ``fill_in_middle`` made an output."""
    check_sentinels(sentinels)
    p, s, m = sentinels

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    def after(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, -1)

    psm = F.concat(after(before(output, s), p), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
