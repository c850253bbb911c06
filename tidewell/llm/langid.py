"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of a word given those before it in the
word, lower-cased; runs of other characters only part words. N-grams are kept by
order in one sorted array of hashes, with a column of log probabilities for each
language, so one search serves all languages. A text goes to the language with
the lowest cross-entropy per symbol and is rejected if that lies outside what the
calibration texts of that language show.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidewell.llm.scratch import column, packed, unpacked
from tidewell.llm.words import U, mix

SPACE = 32
UNSEEN = 1e-7  # share of the mass for characters that no training word has
PIECE = 250_000  # characters that are scored at once
MOST_LETTERS = 10_000  # of one word that are looked through for a cut
SPREAD = 6.0  # standard deviations from the calibration mean that are accepted in any case
FOREIGN = 0.75  # share of the way from own to foreign calibration texts that is accepted too


@dataclass
class Model:
    """``keys[m]``, ``logp[m]``: n-grams of m + 1 characters; ``back[m]``: weights left to shorter contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back_keys: list[np.ndarray]
    back: list[np.ndarray]
    mean: np.ndarray  # cross-entropy of calibration texts
    text_sd: np.ndarray
    symbol_sd: np.ndarray
    foreign: np.ndarray  # lowest cross-entropy of another language's calibration texts


def gram_hash(codes: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given their characters, first to last."""
    value = np.full(len(codes[0]), len(codes), U)
    for c in codes:
        value = mix(value * U(0x9E3779B97F4A7C15) + c.astype(U) + U(1))
    return value


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _kneser_ney(words: Counter, order: int) -> tuple[list[dict], list[dict]]:
    """Log probability of every n-gram and log weight of every context, by order."""
    counts: list[Counter] = [Counter() for _ in range(order)]
    for word, n in words.items():
        padded = " " + word + " "
        for end in range(1, len(padded)):
            for m in range(min(order, end + 1)):
                counts[m][padded[end - m : end + 1]] += n
    left: list[Counter] = [Counter() for _ in range(order)]  # different characters before an n-gram
    for m in range(1, order):
        for gram in counts[m]:
            left[m - 1][gram[1:]] += 1
    prob: list[dict] = []
    weight: list[dict] = []
    characters = len(counts[0]) + 1
    for m in range(order):
        # Nothing precedes a word's start; there, and at the highest order, counts are plain.
        used = {g: (n if m == order - 1 or g[0] == " " and m > 0 else left[m].get(g, 0) or n) for g, n in counts[m].items()}
        of_used = Counter(min(n, 3) for n in used.values())
        discount = min(0.95, max(0.1, of_used[1] / (of_used[1] + 2 * of_used[2]))) if of_used[1] + of_used[2] else 0.5
        total: dict = defaultdict(float)
        kinds: Counter = Counter()
        for g, n in used.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        w = {c: discount * kinds[c] / total[c] for c in total}
        if m == 0:
            lower = lambda g: UNSEEN + (1 - UNSEEN) / characters
        else:
            lower = lambda g, p=prob[-1]: p.get(g[1:], UNSEEN)
        prob.append({g: (n - discount) / total[g[:-1]] + w[g[:-1]] * lower(g) for g, n in used.items()})
        weight.append(w)
    return prob, weight


def _value(gram: str, prob: list[dict], weight: list[dict]) -> float:
    """Log probability of any n-gram under one language's model."""
    out, m = 0.0, len(gram) - 1
    while m >= 0:
        p = prob[m].get(gram)
        if p is not None:
            return out + math.log(p)
        out += math.log(weight[m].get(gram[:-1], 1.0))
        gram, m = gram[1:], m - 1
    return out + math.log(UNSEEN)


def train(samples: dict[str, list[str]], order: int = 4, kept_back: int = 5) -> Model | None:
    """A model from texts by language; every ``kept_back``-th text only calibrates."""
    languages = sorted(samples)
    if not languages:
        return None
    parts = []
    for lang in languages:
        fit = [t for i, t in enumerate(samples[lang]) if i % kept_back or len(samples[lang]) < kept_back]
        parts.append(_kneser_ney(Counter(w for t in fit for w in re.findall(r"[^\W\d_]+", t.lower())), order))
    keys, logp, back_keys, back = [], [], [], []
    for m in range(order):
        for store_k, store_v, grams, value in (
            (keys, logp, sorted({g for p, _ in parts for g in p[m]}), _value),
            (back_keys, back, sorted({c for _, w in parts for c in w[m]}), lambda c, p, w, m=m: math.log(w[m].get(c, 1.0))),
        ):
            hashes = np.concatenate([np.zeros(0, U), gram_hash([np.array([ord(g[k]) for g in grams]) for k in range(len(grams[0]))])]) if grams and grams[0] else np.zeros(len(grams), U)
            values = np.array([[value(g, *part) for part in parts] for g in grams], np.float32).reshape(len(grams), len(parts))
            rank = np.argsort(hashes)
            store_k.append(hashes[rank])
            store_v.append(values[rank])
    model = Model(languages, keys, logp, back_keys, back, *(np.zeros(len(languages)) for _ in range(4)))
    model.foreign[:] = np.inf
    for i, lang in enumerate(languages):
        held = samples[lang][::kept_back]
        total, squares, n = score_texts(held, model)
        ok = n > 0
        if ok.any():
            across = -total[ok].sum(axis=0) / n[ok].sum()
            model.foreign = np.where(np.arange(len(languages)) == i, model.foreign, np.minimum(model.foreign, across))
            each = -total[ok, i] / n[ok]
            model.mean[i] = -total[ok, i].sum() / n[ok].sum()
            model.symbol_sd[i] = math.sqrt(max(1e-6, squares[ok, i].sum() / n[ok].sum() - model.mean[i] ** 2))
            model.text_sd[i] = max(0.05, float(np.median(np.abs(each - np.median(each)))) * 1.5)
    return model


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == wanted) if len(sorted_keys) else np.zeros(len(wanted), bool)


_ALPHA: list[np.ndarray] = []


def pieces(text: str, size: int) -> Iterator[str]:
    """A lower-cased text in pieces of ``size`` characters at most, cut before a character that is no letter.

    Where MOST_LETTERS letters stand before a cut, it parts them.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut > at + size - MOST_LETTERS and text[cut].isalpha():
            cut -= 1
        cut = at + size if text[cut].isalpha() else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def score_texts(texts: list[str | None], model: Model, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability by language, its sum of squares by symbol, and symbols, of each text.

    Texts are scored ``size`` characters at a time, longer ones by pieces.
    """
    shape = (len(texts), len(model.languages))
    total, squares, symbols = np.zeros(shape), np.zeros(shape), np.zeros(len(texts), np.int64)
    held: list[str] = []
    of: list[int] = []

    def flush() -> None:
        for sums, part in zip((total, squares, symbols), _scored(held, model)):
            np.add.at(sums, of, part)
        held.clear()
        of.clear()

    waiting = 0
    for i, t in enumerate(texts):
        for part in pieces((t or "").lower(), size):
            if held and waiting + len(part) > size:
                flush()
                waiting = 0
            held.append(part)
            of.append(i)
            waiting += len(part)
    flush()
    return total, squares, symbols


def _scored(lowered: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _ALPHA:
        _ALPHA.append(_letters())
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = _ALPHA[0][codes]
    cut = np.zeros(len(codes) + 1, bool)
    cut[bounds] = True
    inner = letter[1:-1]
    start = np.flatnonzero(inner & (~letter[:-2] | cut[:-1])) if len(codes) else np.zeros(0, np.int64)
    end = np.flatnonzero(inner & (~letter[2:] | cut[1:])) + 1 if len(codes) else np.zeros(0, np.int64)
    languages = len(model.languages)
    if not len(start):
        return np.zeros((len(lowered), languages)), np.zeros((len(lowered), languages)), np.zeros(len(lowered), np.int64)
    # Each different word is scored once.
    scrambled = mix(codes.astype(U) + U(1))
    total = np.zeros(len(codes) + 1, U)
    owner = np.maximum(np.cumsum(np.bincount(start, minlength=len(codes))) - 1, 0)
    place = np.arange(len(codes)) - start[owner]
    np.cumsum(np.where(inner, mix(scrambled + place.astype(U) * U(0x9E3779B97F4A7C15)), U(0)), out=total[1:])
    name = total[end] - total[start]
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    s, e = start[one], end[one]
    length = e - s
    at = np.cumsum(length + 1) - (length + 1) + 1  # in " w1 w2 ... "
    flat = np.full(int((length + 1).sum()) + 1, SPACE, np.uint32)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(at, length) + inside] = codes[np.repeat(s, length) + inside]
    spot = np.arange(1, len(flat))  # predicted: letters and closing spaces
    depth = spot - np.repeat(at - 1, length + 1)  # symbols before it in its word, its opening space included
    value = _score_spots(flat, spot, depth, model)
    edge = np.concatenate([at - 1, [len(flat) - 1]])
    sums = np.zeros((len(spot) + 1, languages))
    np.cumsum(value, axis=0, out=sums[1:])
    by_word = sums[edge[1:]] - sums[edge[:-1]]
    np.cumsum(value.astype(np.float64) ** 2, axis=0, out=sums[1:])
    squared = sums[edge[1:]] - sums[edge[:-1]]
    first = np.searchsorted(start, bounds)
    out = []
    for per_word in (by_word, squared):
        run = np.zeros((len(start) + 1, languages))
        np.cumsum(per_word[which], axis=0, out=run[1:])
        out.append(run[first[1:]] - run[first[:-1]])
    symbols = np.concatenate([[0], np.cumsum((end - start) + 1)])
    return out[0], out[1], symbols[first[1:]] - symbols[first[:-1]]


def _score_spots(flat: np.ndarray, spot: np.ndarray, depth: np.ndarray, model: Model) -> np.ndarray:
    order = len(model.keys)
    value = np.zeros((len(spot), len(model.languages)), np.float64)
    level = np.minimum(order - 1, depth)
    open_ = np.ones(len(spot), bool)
    for m in range(order - 1, -1, -1):
        here = np.flatnonzero(open_ & (level >= m))
        if not len(here):
            continue
        codes = [flat[spot[here] - m + k] for k in range(m + 1)]
        at, found = _find(model.keys[m], gram_hash(codes))
        value[here[found]] += model.logp[m][at[found]]
        open_[here[found]] = False
        missing = here[~found]
        if len(missing) and not m and len(model.back[0]):
            value[missing] += model.back[0][0]
        elif len(missing) and m:
            at, known = _find(model.back_keys[m], gram_hash([c[~found] for c in codes[:-1]]))
            value[missing[known]] += model.back[m][at[known]]
    value[open_] += math.log(UNSEEN)
    return value


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        pred, score, entropy, rejected = [], [], [], []
        if model is None:
            pred, score, entropy, rejected = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        else:
            total, _, n = score_texts(texts, model)
            per = -total / np.maximum(n, 1)[:, None]
            best = per.argmin(axis=1)
            low = per[np.arange(len(texts)), best]
            sure = 1.0 / np.exp(-(per - low[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
            bound = model.mean[best] + SPREAD * (model.text_sd[best] + model.symbol_sd[best] / np.sqrt(np.maximum(n, 1)))
            reach = np.where(np.isfinite(model.foreign), model.mean + FOREIGN * (model.foreign - model.mean), 0.0)
            bound = np.maximum(bound, reach[best])
            for i in range(len(texts)):
                known = n[i] > 0
                pred.append(model.languages[best[i]] if known else "und")
                score.append(float(sure[i]) if known else 0.0)
                entropy.append(float(low[i]) if known else None)
                rejected.append(bool(not known or low[i] > bound[i]))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_()), batch.column(batch.num_columns - 1)], [*batch.schema.names[:-1], "lang_pred", "score", "entropy", "rejected", "_text"])


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def language_sample(labelled: DataFrame, text_col: str, lang_col: str, per_language: int, sample_bytes: int) -> dict[str, list[str]]:
    """At most ``per_language`` different whole texts of each language, chosen by hash of the text; copies count once.

    All languages share ``sample_bytes`` evenly, in UTF-8; texts longer than a language's share are passed over.
    """
    labelled = labelled.select(column(text_col).alias("text"), column(lang_col).alias("lang")).where("text is not null and lang is not null")
    languages = labelled.agg(F.count_distinct("lang")).first()[0]
    share = sample_bytes // max(1, languages)
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    sized = labelled.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("bigint").alias("size")).where(F.col("size") <= share)
    chosen = sized.withColumn("k", F.expr("row_number() over (partition by lang order by h)")).where(F.col("k") <= per_language)
    chosen = chosen.withColumn("upto", F.expr("sum(size) over (partition by lang order by k)")).where(F.col("upto") <= share).select("lang", "h", "k")
    # Grouped by text, so tasks merge the copies before they send them.
    first = labelled.join(F.broadcast(chosen) if languages <= 1000 else chosen, ["lang", "h"]).select("lang", "text", "k").distinct()
    out: dict[str, list[tuple[int, str]]] = {}
    for row in first.collect():  # sample_bytes at most
        out.setdefault(row.lang, []).append((row.k, row.text))
    return {lang: [t for _, t in sorted(texts)[:per_language]] for lang, texts in out.items()}


def identify_language(
    documents: DataFrame, labelled: DataFrame, *, text_col: str = "text", train_text: str = "text", train_lang: str = "lang", order: int = 4, per_language: int = 300,
    sample_bytes: int = 64_000_000,
) -> DataFrame:
    """``documents`` with ``lang_pred, score, entropy, rejected``; the text stays.

    Models are fitted on ``per_language`` whole texts of each language of
    ``labelled`` at most, ``sample_bytes`` in all. A word of over 10,000 letters may count as several. ``lang_pred`` is the language of lowest cross-entropy per
    symbol, ``und`` for a null text or one without a letter; ``score`` (0 to 1) is
    its share against the other languages, ``rejected`` whether the text is ``und``
    or its cross-entropy lies beyond what calibration texts show: more than SPREAD
    deviations above their mean and FOREIGN of the way to those of other languages.
    Ties go to the first language by name. Without labelled rows all is ``und``.
    Repeated rows repeat; an empty table gives an empty result; other columns,
    also ones that bear the new names, are replaced only by the new ones.
    """
    model = train(language_sample(labelled, train_text, train_lang, per_language, sample_bytes), order)
    new = ("lang_pred", "score", "entropy", "rejected")
    rows = documents.select(packed(documents, text_col, *new), column(text_col).alias("_text"))
    kinds = zip(new, (StringType(), DoubleType(), DoubleType(), BooleanType()))
    schema = StructType([rows.schema["rest"], *(StructField(n, k) for n, k in kinds), StructField("_text", StringType())])
    done = rows.mapInArrow(lambda it: _predict(it, model), schema)
    return done.select(*unpacked(documents, text_col, *new), *new, F.col("_text").alias(text_col))
