"""Phrase collocations: which runs of two to four words stick together, by language.

Words that occur often enough in their language get dictionary numbers; other words
break a piece of text, since no frequent phrase can hold them. Each position then
gives one fixed-width key of 16 bytes, the numbers of its word and of up to three that
follow. A phrase's occurrences are the keys that begin with it, so one sort counts
phrases of every length: tasks radix-sort blocks of keys and merge equal ones, keys
are range-partitioned and sorted, and runs of equal prefixes are counted as they pass.
A run that crosses ranges is summed from its parts.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidewell.llm.ranges import running
from tidewell.llm.scratch import Scratch, column
from tidewell.llm.words import Slice, U, mix, signed, slices

BREAKS = b".,;:!?\n\v\f\r"
#: Words of the dictionary sent to a task at once, 12 bytes each; a longer dictionary takes several passes.
SLICE_WORDS = 4_000_000
FLUSH_BYTES = 32_000_000  # of text, after which a task sends its word counts on
BLOCK_KEYS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in BREAKS else b for b in range(256))
_WORD = np.ones(256, bool)
_WORD[[*b" \t", *BREAKS]] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_HIGH = -(1 << 32)  # the upper half of a long


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)`` of a bounded amount of text at a time; a null word has the number of all words."""
    found: dict[str, Counter] = defaultdict(Counter)
    read = 0

    def flush() -> pa.RecordBatch:
        rows = [(lang, w.decode(), n) for lang, words in found.items() for w, n in words.items()]
        rows += [(lang, None, sum(words.values())) for lang, words in found.items()]
        found.clear()
        lang, word, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode()
            found[lang].update(data.translate(_LOWER).split())
            read += len(data)
            if read >= FLUSH_BYTES:
                yield flush()
                read = 0
    yield flush()


def _language(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _hashes(part: Slice, langs: list[str]) -> np.ndarray:
    """64-bit hashes of a slice's words together with their languages."""
    known = {lang: _language(lang) for lang in set(langs)}
    each = np.array([known[lang] for lang in langs], U) if langs else np.zeros(0, U)
    return signed(mix(part.hash ^ np.repeat(each, np.diff(part.at))))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary rows with the hash that texts give their words."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        h = [_hashes(part, langs[part.first : part.first + part.n]) for part in slices(batch.column(1), _WORD)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*h, np.zeros(0, np.int64)]))], ["lang", "word", "n", "h"])


def _numbers(part: Slice, langs: list[str], hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The dictionary number of each word of the slice, 0 for none."""
    h = _hashes(part, langs)
    if not len(hashes):
        return np.zeros(len(h), np.uint32)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, ids[at], np.uint32(0))


def _keys(part: Slice, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word with a frequent one after it: its number and those of the next words of its piece, as two longs."""
    n = len(number)
    text = np.repeat(np.arange(part.n), np.diff(part.at))
    piece = np.concatenate([[0], np.cumsum(_BREAK[part.data])])[part.start] + text  # breaks and text bounds before it
    wide = [number.astype(U)]
    go = number > 0
    for k in (1, 2, 3):
        m = max(0, n - k)
        go[m:] = False
        go[:m] &= (piece[k:] == piece[:m]) & (number[k:] > 0)
        word = np.zeros(n, U)
        word[:m] = np.where(go[:m], number[k:], 0)
        wide.append(word)
    at = np.flatnonzero(wide[1])
    a, b, c, d = (w[at] for w in wide)
    return a << U(32) | b, c << U(32) | d


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by unsigned 64-bit columns, the first one leading: stable counting passes over 16-bit digits."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> U(shift)).astype(np.uint16)
            if digit.any():  # numpy sorts 16-bit numbers by radix
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _block(hi: list[np.ndarray], lo: list[np.ndarray]) -> pa.RecordBatch:
    """The keys of a block, sorted, equal ones merged with their number."""
    a, b = np.concatenate(hi), np.concatenate(lo)
    order = radix_order(a, b)
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(signed(a[at])), pa.array(signed(b[at])), pa.array(np.diff(np.append(at, len(a))))], ["hi", "lo", "n"])


def _coded(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, ids: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """Words as numbers by this slice of the dictionary and the ones before; from the last slice on, keys."""
    hi: list[np.ndarray] = []
    lo: list[np.ndarray] = []
    held = 0
    for batch in batches:
        langs, done = batch.column(0).to_pylist(), []
        for part in slices(batch.column(1), _WORD):
            number = _numbers(part, langs[part.first : part.first + part.n], hashes, ids)
            before = [b.as_py() for b in batch.column(2).slice(part.first, part.n) if b.is_valid]
            if before:
                number = np.maximum(number, np.frombuffer(b"".join(before), np.uint32))
            if last:
                a, b = _keys(part, number)
                hi.append(a)
                lo.append(b)
                held += len(a)
                if held >= BLOCK_KEYS:
                    yield _block(hi, lo)
                    hi, lo, held = [], [], 0
            else:
                done += [number[part.at[i] : part.at[i + 1]].astype(np.uint32).tobytes() for i in range(part.n)]
        if not last:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["lang", "text", "codes"])
    if held:
        yield _block(hi, lo)


def _run_lengths(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``(hi, lo, f)`` of prefixes of two to four words in sorted keys.

    Runs inside the range are given if they reach ``least``; those at its ends always,
    as they may go on in the range before or after.
    """
    masks = (0, _HIGH, -1)
    open_: list[tuple[int, int, int, bool] | None] = [None] * 3
    leads = [True] * 3

    def row(hi: np.ndarray, lo: np.ndarray, f: np.ndarray, k: int) -> pa.RecordBatch:
        there = (np.ones(len(hi), bool), lo != 0, (lo & 0xFFFFFFFF) != 0)[k]  # the phrase has so many words
        return pa.RecordBatch.from_arrays([pa.array(hi[there]), pa.array(lo[there]), pa.array(f[there])], ["hi", "lo", "f"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, n = (batch.column(i).to_numpy() for i in range(3))
        for k, mask in enumerate(masks):
            low = lo & mask
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (low[1:] != low[:-1])
            at = np.flatnonzero(new)
            a, b, f = hi[at], low[at], np.add.reduceat(n, at)
            edge = np.zeros(len(at), bool)
            run = open_[k]
            if run is None:
                edge[0] = leads[k]
                leads[k] = False
            elif (run[0], run[1]) == (a[0], b[0]):
                f[0] += run[2]
                edge[0] = run[3]
            elif run[3] or run[2] >= least:
                yield row(*(np.array([x], np.int64) for x in run[:3]), k)
            open_[k] = (int(a[-1]), int(b[-1]), int(f[-1]), bool(edge[-1]))
            good = np.flatnonzero(edge[:-1] | (f[:-1] >= least))
            yield row(a[good], b[good], f[good], k)
    for k, run in enumerate(open_):
        if run is not None:
            yield row(*(np.array([x], np.int64) for x in run[:3]), k)


def _dictionary(texts: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Frequent words ``(lang, word, n, h, id)``, numbered from 1, and ``(lang, n)``, all words of each language."""
    counted = texts.mapInArrow(_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    named = counted.where("word is not null").mapInArrow(_named, "lang string, word string, n bigint, h bigint")
    numbered = running(named, [F.col("h"), F.col("lang"), F.col("word")], {"id": F.lit(1)}, scratch, "numbered")
    return scratch.save(numbered, "dictionary"), counted.where("word is null").select("lang", "n")


def _sorted_keys(texts: DataFrame, dictionary: DataFrame, scratch: Scratch) -> DataFrame:
    """``(hi, lo, n)``, range-partitioned and sorted."""
    size = dictionary.count()
    if size >= 1 << 32:
        raise ValueError("more frequent words than 32-bit numbers")
    coded = texts.withColumn("codes", F.lit(None).cast("binary"))
    between = StructType([StructField("lang", StringType()), StructField("text", StringType()), StructField("codes", BinaryType())])
    keys = StructType([StructField(c, LongType()) for c in ("hi", "lo", "n")])
    starts = range(0, max(size, 1), SLICE_WORDS)
    for nth, start in enumerate(starts):
        part = dictionary.where((F.col("id") > start) & (F.col("id") <= start + SLICE_WORDS)).select("h", "id").toArrow()  # SLICE_WORDS rows at most
        h, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
        order = np.argsort(h, kind="stable")
        h, ids, last = h[order], ids[order].astype(np.uint32), start == starts[-1]
        coded = scratch.save(coded.mapInArrow(lambda it, h=h, ids=ids, last=last: _coded(it, h, ids, last), keys if last else between), f"coded{nth}")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coded.repartitionByRange(n, "hi", "lo").sortWithinPartitions("hi", "lo")


def _key(*words: Column) -> Column:
    a, b, c, d = (*words, *[F.lit(0).cast("bigint")] * (4 - len(words)))
    return F.struct(F.shiftleft(a, 32).bitwiseOR(b).alias("hi"), F.shiftleft(c, 32).bitwiseOR(d).alias("lo"))


def _among(phrases: DataFrame, dictionary: DataFrame, cover: int) -> DataFrame:
    """Candidates ``(hi, lo, w1..w4, a, l, r, score)`` that no longer one covers, by their lowest-scoring cut."""
    word = {f"w{i}": F.expr(e) for i, e in enumerate(("shiftrightunsigned(hi, 32)", "hi & 4294967295", "shiftrightunsigned(lo, 32)", "lo & 4294967295"), 1)}
    named = phrases.withColumns(word)
    w1, w2, w3, w4 = (F.col(c) for c in word)
    key = F.struct("hi", "lo")
    third, fourth = w3 > 0, w4 > 0

    def part(slot: int, key: Column, there: Column = F.lit(True)) -> Column:
        return F.when(there, F.struct(F.lit(slot).alias("slot"), key.alias("part")))

    cuts = [part(1, _key(w1)), part(2, _key(w2, w3, w4)), part(3, _key(w1, w2), third), part(4, _key(w3, w4), third), part(5, _key(w1, w2, w3), fourth), part(6, _key(w4), fourth)]
    parts = named.select(key.alias("whole"), F.explode(F.array_compact(F.array(*cuts))).alias("x")).select("whole", "x.slot", "x.part")
    counts = phrases.select(key.alias("k"), "f").union(dictionary.select(_key(F.col("id")), "n"))
    found = parts.join(counts, F.col("part") == F.col("k")).select("whole", "slot", "f")
    inner = [part(7, _key(w1, w2)), part(7, _key(w2, w3)), part(7, _key(w3, w4), fourth), part(7, _key(w1, w2, w3), fourth), part(7, _key(w2, w3, w4), fourth)]
    covered = named.where(third).select("f", F.explode(F.array_compact(F.array(*inner))).alias("x")).select(F.col("x.part").alias("whole"), "x.slot", "f")
    facts = found.unionByName(covered).unionByName(phrases.select(key.alias("whole"), F.lit(0).alias("slot"), "f"))
    slots = {"a": 0, "l1": 1, "r1": 2, "l2": 3, "r2": 4, "l3": 5, "r3": 6, "cover": 7}
    one = facts.groupBy("whole").agg(*(F.max(F.when(F.col("slot") == s, F.col("f"))).alias(name) for name, s in slots.items()))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    one = one.where(F.col("cover").isNull() | (wide("cover") * 100 < wide("a") * cover))
    score = "(cast(a as decimal(20,0)) * 2000000) div cast(l{k} + r{k} as decimal(20,0))"
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(score.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]
    best = one.select("whole.hi", "whole.lo", "a", F.array_min(F.array_compact(F.array(*cut))).alias("cut"))
    return best.select("hi", "lo", "a", "cut.l", "cut.r", "cut.score").withColumns(word)


def collocations(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, cover: int = 80, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to four words.

    A-Z is lower-cased; ``.,;:!?`` and line breaks part pieces, spaces and tabs words.
    A phrase that occurs ``a >= min_count`` times in pieces, overlaps included, is cut
    where ``floor(2000000 a / (l + r))`` is lowest, ``l`` and ``r`` counting its two
    parts; ties go to the first cut. Phrases inside a longer one that occurs at least
    ``cover`` percent as often are left out. Order is by score and ``a``, both
    descending, then by the phrase's bytes. ``n`` counts all words of the language.

    Null text is empty, null lang is ``und``; repeated rows count as often as they
    stand; ids and extra columns are ignored; an empty table gives an empty result.
    Words go by 64-bit hashes of word and language.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    scratch = Scratch(documents.sparkSession, "collocations")
    texts = documents.select(F.coalesce(column(lang_col), F.lit("und")).alias("lang"), column(text_col).alias("text"))
    dictionary, totals = _dictionary(texts, min_count, scratch)
    keys = _sorted_keys(texts, dictionary, scratch)
    runs = keys.mapInArrow(lambda it: _run_lengths(it, min_count), "hi bigint, lo bigint, f bigint")
    phrases = scratch.save(runs.groupBy("hi", "lo").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrases")
    chosen = _among(phrases, dictionary, cover).join(dictionary.select("lang", F.col("id").alias("w1")), "w1")
    # Ties stay in until their words are known. Spark ranks within each task first.
    chosen = chosen.withColumn("place", F.expr("rank() over (partition by lang order by score desc, a desc)")).where(F.col("place") <= top).drop("place")
    chosen = scratch.save(chosen, "chosen")
    spelt = chosen.select("hi", "lo", F.posexplode(F.array("w1", "w2", "w3", "w4")).alias("pos", "id")).where("id > 0").join(dictionary.select("id", "word"), "id")
    spelt = spelt.groupBy("hi", "lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = chosen.join(spelt, ["hi", "lo"]).withColumn("rank", F.expr("cast(row_number() over (partition by lang order by score desc, a desc, phrase) as int)")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
