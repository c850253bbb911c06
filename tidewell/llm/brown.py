"""Language-model scores from Brown classes.

Classes are found by exchange clustering. A first exchange, on the driver, moves
the most frequent words one at a time to the class that raises the likelihood of
the class bigrams most. Then come rounds of distributed exchange over every word
seen more than once: all occurrences of a word say which classes surround it, and
it moves to the class of highest gain, all words at once. In the first of these
rounds words that have no class yet count, as neighbours, by the octave of their
count. Words seen once stand for unseen ones and make up one class. A text's
probability is the product of class transitions (Witten-Bell smoothed) and word
emissions; its perplexity is the inverse of the mean probability of its tokens.

All counts cover all training texts. Tables sent with tasks are bounded by a
number of words, not by the corpus; counts and classes of rarer words are joined,
in the exchange as in the scores, so every word seen more than once counts with
its own class as another's neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.langid import fold
from tidewell.llm.scratch import Scratch
from tidewell.llm.words import Slice, buffers, mix, signed, slices, U

GROWS_FROM = 100_000  # words seen more than once, from which clustered words and classes grow
END = int(signed(mix(np.array([0xE0D], U)))[0])


def _tokens(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word names of all texts of a slice, each text followed by END, and text bounds."""
    at = part.at + np.arange(part.n + 1)
    out = np.full(len(part.hash) + part.n, END, np.int64)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = signed(part.hash)
    return out, at


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for part in slices(batch.column(0)):
            words, n = np.unique(_tokens(part)[0], return_counts=True)
            held.append((words, n))
            size += len(words)
        if size > 1_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["word", "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["word", "n"])


@dataclass
class Vocabulary:
    """Known words, sorted by name: count and rank by count of each, and the least count that was taken."""

    word: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    least: int

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token, -1 where it is not among them."""
        at = np.searchsorted(self.word, tokens)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == tokens, at, -1) if len(self.word) else np.full(len(tokens), -1)


def _pairs(part: Slice, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word before and word at each token of a slice, by name and by index; a text's first word follows END."""
    tokens, _ = _tokens(part)
    found = vocabulary.find(tokens)
    return np.concatenate([[END], tokens[:-1]]), tokens, np.concatenate([vocabulary.find(np.array([END])), found[:-1]]), found


def _bigrams(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, symbol: np.ndarray, symbols: int, joined: bool) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring symbols; where others are ``joined``, of known words only."""
    total = np.zeros(symbols * symbols, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            _, _, before, at = _pairs(part, vocabulary)
            k = (before >= 0) & (at >= 0) if joined else slice(None)
            np.add.at(total, symbol[before[k]] * symbols + symbol[at[k]], 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])


def _listed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each word with its (code, count) entries, given in order of words."""
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    entry = np.empty((len(code), 2), np.uint32)
    entry[:, 0], entry[:, 1] = code, n
    offsets = np.append(first, len(word)).astype(np.int32) * entry.itemsize * 2
    near = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(entry.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(word[first]), near], ["word", "near"])


def _summed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The same with entries in any order, which are added up."""
    order = np.lexsort((code, word))
    word, code, n = word[order], code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (code[1:] != code[:-1])]))
    return _listed(word[first], code[first], np.add.reduceat(n, first))


def _open(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """For each word that is not known, the known words beside it: entries of index and side, odd where they follow it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        word, code = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        return _summed(word, code, np.ones(len(word), np.int64))

    for batch in batches:
        for part in slices(batch.column(0)):
            before, at, i, j = _pairs(part, vocabulary)
            k, m = np.flatnonzero((i >= 0) & (j < 0)), np.flatnonzero((i < 0) & (j >= 0))
            held.append((np.concatenate([at[k], before[m]]), np.concatenate([i[k] * 2, j[m] * 2 + 1])))
            size += len(k) + len(m)
            if size > 1_000_000:
                yield merged()
                held, size = [], 0
    if size:
        yield merged()


def _open_pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Neighbouring words of which neither is known, once for each time."""
    for batch in batches:
        for part in slices(batch.column(0)):
            before, at, i, j = _pairs(part, vocabulary)
            k = (i < 0) & (j < 0)
            yield pa.RecordBatch.from_arrays([pa.array(before[k]), pa.array(at[k])], ["a", "b"])


def _class_pairs(total: np.ndarray) -> pa.RecordBatch:
    """Counts of class pairs as one row without a word."""
    some = np.flatnonzero(total)
    row = _listed(np.zeros(len(some), np.int64), some, total[some]) if len(some) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["word", "near"])
    return pa.RecordBatch.from_arrays([pa.nulls(row.num_rows, pa.int64()), row.column(1)], ["word", "near"])


def _beside_known(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, of_word: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Entries of known words from (class, near) of the words beside them, and the counts of those class pairs."""
    total = np.zeros(width * width, np.int64)
    end = vocabulary.find(np.array([END]))[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        off, raw = buffers(batch.column(1))
        entry = raw.view(np.uint32).reshape(-1, 2).astype(np.int64)
        own = np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(off) // 8)
        index, follows, n = entry[:, 0] // 2, entry[:, 0] % 2 == 1, entry[:, 1]
        of = of_word[index]
        np.add.at(total, np.where(follows, own * width + of, of * width + own), n)
        code = np.where(follows, own * (width + 1) + width, width * (width + 1) + own)
        k = index != end
        if k.any():
            yield _summed(vocabulary.word[index[k]], code[k], n[k])
    yield _class_pairs(total)


def _beside_open(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same from (a, b, class of a, class of b)."""
    total = np.zeros(width * width, np.int64)
    for batch in batches:
        if batch.num_rows:
            a, b, c, d = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            np.add.at(total, c * width + d, 1)
            yield _summed(np.concatenate([a, b]), np.concatenate([width * (width + 1) + d, c * (width + 1) + width]), np.ones(2 * len(a), np.int64))
    yield _class_pairs(total)


def _contexts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, of_word: np.ndarray, slot: np.ndarray, slots: int, width: int, joined: bool) -> Iterator[pa.RecordBatch]:
    """How often which classes surround each word.

    An entry's code is ``before * (width + 1) + after``, with ``width`` for a side
    that the entry leaves out. ``slot`` is -2 for words without contexts; words with
    a slot are summed by side, all others, -1, are listed. Where the classes of words
    that are not known are ``joined``, their sides are left out.
    """
    total = np.zeros((slots, 2 * width), np.int64)
    flat = total.reshape(-1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        word, code = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        return _summed(word, code, np.ones(len(word), np.int64))

    for batch in batches:
        for part in slices(batch.column(0)):
            tokens, _ = _tokens(part)
            found = vocabulary.find(tokens)
            c, w = of_word[found], slot[found]
            if joined:
                c = np.where(found < 0, width, c)
            before = np.concatenate([[of_word[vocabulary.find(np.array([END]))[0]]], c[:-1]])
            after = np.concatenate([c[1:], c[:1]])  # a slice ends with END, which has no contexts
            w[-1] = -2
            w[tokens == END] = -2
            for near, start in ((before, 0), (after, width)):
                k = np.flatnonzero((w >= 0) & (near < width))
                np.add.at(flat, w[k] * 2 * width + start + near[k], 1)
            k = np.flatnonzero((w == -1) & ((before < width) | (after < width)))
            held.append((tokens[k], (before[k] * (width + 1) + after[k]).astype(np.uint32)))
            size += len(k)
            if size > 1_000_000:
                yield merged()
                held, size = [], 0
    if size:
        yield merged()
    some = np.flatnonzero(flat)
    if len(some):
        word = np.zeros(slots, np.int64)
        word[slot[:-1][slot[:-1] >= 0]] = vocabulary.word[slot[:-1] >= 0]
        near = some % (2 * width)
        code = np.where(near < width, near * (width + 1) + width, width * (width + 1) + near - width)
        yield _listed(word[some // (2 * width)], code, flat[some])


def _assign(batches: Iterator[pa.RecordBatch], behind: np.ndarray, ahead: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class of each word, whose rows follow one another: that of the highest gain of likelihood."""
    width, classes = behind.shape

    def classed(words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        n = sums[:, :width].sum(axis=1).astype(np.int64)
        best = (sums[:, :width] @ behind + sums[:, width:] @ ahead).argmax(axis=1)
        best[n < 2] = classes + 1
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    last, open_ = np.zeros(0, np.int64), np.zeros((0, 2 * width))
    for batch in batches:
        if not batch.num_rows:
            continue
        off, raw = buffers(batch.column(1))
        entry = raw.view(np.uint32).reshape(-1, 2).astype(np.int64)
        rows = np.concatenate([last, batch.column(0).to_numpy()])
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        group = (np.cumsum(first) - 1)[len(last) :]
        words = rows[first]
        sums = np.zeros((len(words), 2 * width))
        sums[: len(last)] = open_
        at = np.repeat(group, np.diff(off) // 8)
        before, after = entry[:, 0] // (width + 1), entry[:, 0] % (width + 1)
        for near, start in ((before, 0), (after, width)):
            k = near < width
            np.add.at(sums, (at[k], near[k] + start), entry[k, 1])
        yield classed(words[:-1], sums[:-1])
        last, open_ = words[-1:], sums[-1:]
    if len(last):
        yield classed(last, open_)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, movable: int, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each symbol: the first ``movable`` are clustered, each other keeps its own class.

    ``counts[a, b]`` is how often symbol b follows a. Maximises the sum of
    N(g,h) log N(g,h) over class pairs less that of N(g,.) and N(.,g) over classes.
    """
    symbols = len(counts)
    own = np.concatenate([np.arange(movable) % classes, classes + np.arange(symbols - movable)])
    width = classes + symbols - movable
    member = np.zeros((symbols, width))
    member[np.arange(symbols), own] = 1
    table = member.T @ counts @ member
    after, before = counts @ member, counts.T @ member  # by symbol: classes after it, before it
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            old, itself = own[w], float(counts[w, w])
            out_, in_ = after[w].copy(), before[w].copy()
            out_[old] -= itself
            in_[old] -= itself
            table[old] -= out_
            table[:, old] -= in_
            table[old, old] -= itself
            # Wherever the word goes, its neighbours' classes keep it as a follower or predecessor.
            rows, cols = table.sum(axis=1) + in_, table.sum(axis=0) + out_
            t = table[:classes]
            gain = (_xlogx(t + out_) - _xlogx(t)).sum(axis=1) + (_xlogx(table[:, :classes].T + in_) - _xlogx(table[:, :classes].T)).sum(axis=1)
            diag = np.arange(classes)
            d, o, i = table[diag, diag], out_[:classes], in_[:classes]
            gain += _xlogx(d + o + i + itself) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
            total_o, total_i = out_.sum() + itself, in_.sum() + itself
            gain -= _xlogx(rows[:classes] + total_o) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + total_i) - _xlogx(cols[:classes])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += out_
            table[:, new] += in_
            table[new, new] += itself
            if new != old:
                moved += 1
                own[w] = new
                for near, table_ in ((after, counts[:, w]), (before, counts[w])):
                    near[:, old] -= table_
                    near[:, new] += table_
        if not moved:
            break
    return own


@dataclass
class Classes:
    """Class of each known word (the last one is for all others), emissions, and the masses of classes."""

    vocabulary: Vocabulary
    of_word: np.ndarray
    emission: np.ndarray  # log10
    mass: np.ndarray
    end: int  # the class of END; the one after it is that of words seen once and unseen ones

    def code(self) -> type:
        """Type of a class in a text's sequence; its largest value marks a word that is not known."""
        return np.uint8 if len(self.mass) < 255 else np.uint16


def _encoded(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    """Per text: tokens, known tokens, log10 of known counts and emissions, classes in order, rare words."""
    log_count = np.append(np.log10(classes.vocabulary.count + 0.5), 0.0)
    code = classes.code()
    for batch in batches:
        for part in slices(batch.column(1)):
            tokens, at = _tokens(part)
            found = classes.vocabulary.find(tokens)
            rare = found < 0
            seq = np.where(rare, np.iinfo(code).max, classes.of_word[found]).astype(code)

            def summed(x: np.ndarray) -> np.ndarray:
                run = np.concatenate([[0], np.cumsum(x)])
                return run[at[1:]] - run[at[:-1]]

            bounds = np.concatenate([[0], np.cumsum(rare)])[at]
            words = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens[rare]))
            seqs = pa.Array.from_buffers(pa.binary(), part.n, [None, pa.py_buffer((at * seq.itemsize).astype(np.int32)), pa.py_buffer(seq.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.first, part.n), pa.array(np.diff(at)), pa.array(summed(~rare)), pa.array(summed(log_count[found])), pa.array(summed(np.where(rare, 0.0, classes.emission[found]))), seqs, words],
                ["id", "n_tokens", "n_found", "log_counts", "log_emission", "seq", "rare"],
            )


def _filled(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    """The same with the joined counts and classes of rare words put in their places."""
    code = classes.code()
    other = classes.end + 1
    unseen_mass = classes.mass[other] + 0.5 * (classes.mass[other] + 1)  # its words have one count each
    for batch in batches:
        off, raw = buffers(batch.column(5))
        seq = raw.view(code).copy()
        at = off // seq.itemsize
        found = batch.column(6)
        size = np.asarray(found.value_lengths().fill_null(0))
        row = np.repeat(np.arange(len(size)), size)
        k, c, n = (found.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        spots = np.flatnonzero(seq == np.iinfo(code).max)
        place = spots[np.searchsorted(spots, at[row]) + k]
        seq[place] = c
        emission = np.where(n > 1, np.log10(np.maximum(n, 1) / np.maximum(classes.mass[c], 1)), np.log10(n + 0.5) - np.log10(unseen_mass))

        def summed(x: np.ndarray) -> np.ndarray:
            return np.bincount(row, x, minlength=len(size))

        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(batch.column(2).to_numpy() + summed(n > 0).astype(np.int64)), pa.array(batch.column(3).to_numpy() + summed(np.log10(n + 0.5))), pa.array(batch.column(4).to_numpy() + summed(emission)),
             pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(seq.tobytes())])],
            ["id", "n_tokens", "n_known", "log_counts", "log_emission", "seq"],
        )


def _steps(column: pa.Array, code: type, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before and at each token of the texts, which end with END, and text bounds."""
    off, raw = buffers(column)
    seq = raw.view(code).astype(np.int64)
    return np.concatenate([[end], seq[:-1]]), seq, off // np.dtype(code).itemsize


def _transitions(batches: Iterator[pa.RecordBatch], code: type, end: int, width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(width * width, np.int64)
    for batch in batches:
        if batch.num_rows:
            before, seq, _ = _steps(batch.column(0), code, end)
            total += np.bincount(before * width + seq, minlength=width * width)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])


def _class_scores(batches: Iterator[pa.RecordBatch], code: type, end: int, transition: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_columns - 1
        if batch.num_rows:
            before, seq, at = _steps(batch.column(k), code, end)
            run = np.concatenate([[0], np.cumsum(transition[before, seq])])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(run[at[1:]] - run[at[:-1]])], [*batch.schema.names[:k], "log_class"])


def grown(words: int, clustered: int, classes: int) -> tuple[int, int]:
    """Numbers of clustered words and of classes for a vocabulary of so many words seen more than once."""
    times = max(1.0, words / GROWS_FROM)
    return round(clustered * times ** (1 / 3)), round(classes * times ** (1 / 6))


def class_model_scores(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1,
    known: int = 200_000, assigned: int = 8_000, clustered: int = 600, classes: int = 40, rounds: int = 2,
) -> DataFrame:
    """``(<id>, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` for every document.

    Learns from documents whose id's fold is not ``held_fold``. Tokens are the
    words (runs of non-blank bytes, A-Z lower-cased) and one end. ``base_score`` is
    the add-half unigram score, ``score`` the class model's log10 probability.

    ``clustered`` words start the ``classes`` off, for up to GROWS_FROM words seen
    more than once; with more, both grow (see ``grown``). Every word seen more than
    once is then exchanged ``rounds`` times. ``known`` words are sent with tasks and
    ``assigned`` words' contexts summed inside them; the classes of other words are
    joined. Neither changes what counts once words have classes; only in the first
    round, which starts from ``clustered`` words, do words beyond the known ones
    count as neighbours with those seen once.

    A null text is empty: its end is its only token. A null id has the fold of
    empty text. Repeated rows count and are scored each. Ties between equally
    frequent words go by word hash. Without training tokens every base
    probability is that of an unseen word and the scores are equal. An empty table
    gives an empty result; extra columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "brown")
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    train = docs.where(fold(F.col("id"), folds) != held_fold).select("text")
    counts = scratch.save(train.mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, kinds, repeated = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") > 1)).first()
    # Words seen once stand for those not seen at all: they are never among the known ones.
    vocabulary = _known(counts, known)
    scratch.drop("counts")
    fitted, classed = _fit(train, vocabulary, scratch, assigned, rounds, *grown(int(repeated), clustered, classes))
    code, end, width = fitted.code(), fitted.end, fitted.end + 2
    encoded = docs.mapInArrow(lambda it: _encoded(it, fitted), "id bigint, n_tokens bigint, n_found bigint, log_counts double, log_emission double, seq binary, rare array<bigint>")
    encoded = scratch.save(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    rare = encoded.select("row", F.posexplode("rare").alias("k", "word")).join(classed, "word", "left")
    found = rare.groupBy("row").agg(F.collect_list(F.struct("k", F.coalesce("class", F.lit(end + 1)).alias("c"), F.coalesce("n", F.lit(0)).alias("n"))).alias("found"))
    filled = encoded.join(found, "row", "left").select("id", "n_tokens", "n_found", "log_counts", "log_emission", "seq", "found")
    filled = scratch.save(filled.mapInArrow(lambda it: _filled(it, fitted), "id bigint, n_tokens bigint, n_known bigint, log_counts double, log_emission double, seq binary"), "filled")
    scratch.drop("encoded")
    held = fold(F.col("id"), folds) == held_fold
    got = filled.where(~held).select("seq").mapInArrow(lambda it: _transitions(it, code, end, width), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    transition = _smoothed(table.reshape(width, width))
    scored = filled.mapInArrow(lambda it: _class_scores(it, code, end, transition), "id bigint, n_tokens bigint, n_known bigint, log_counts double, log_emission double, log_class double")
    base = F.col("log_counts") - F.col("n_tokens") * float(np.log10(total + 0.5 * (kinds + 1)))
    score = F.col("log_class") + F.col("log_emission") if total else base
    return scored.select(
        F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def _known(counts: DataFrame, most: int) -> Vocabulary:
    """The most frequent words seen more than once, ``most`` at most, and END.

    A histogram by sixteenths of an octave says from which count on they are; words
    of the count class that doesn't fit whole are left to the joins.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    frequent = counts.where("n > 1").withColumn("step", step)
    histogram = sorted(((r.step, r["count"], r.least) for r in frequent.groupBy("step").agg(F.count("*").alias("count"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, words, lowest in histogram:
        total += words
        if total > most:
            break
        least = lowest
    top = counts.where((F.col("n") >= least) | (F.col("word") == END)).toArrow()
    name, count = top["word"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(name)
    name, count = name[order], count[order]
    rank = np.empty(len(name), np.int64)
    rank[np.lexsort((name, -count, name != END))] = np.arange(len(name))
    return Vocabulary(name, count, rank, least)


def _counted(train: DataFrame, vocabulary: Vocabulary, symbol: np.ndarray, symbols: int, joined: bool = False) -> np.ndarray:
    """How often symbol b follows a."""
    got = train.mapInArrow(lambda it: _bigrams(it, vocabulary, symbol, symbols, joined), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(symbols * symbols)
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(symbols, symbols)


def _surroundings(train: DataFrame, vocabulary: Vocabulary, of_word: np.ndarray, slot: np.ndarray, slots: int, width: int, classed: DataFrame | None, scratch: Scratch, name: str) -> tuple[np.ndarray, DataFrame]:
    """How often class b follows a, and ``(word, near)``: the classes beside each word.

    Known words have the classes of ``of_word``; others those of ``classed(word,
    class)``, or without it that of the last of ``of_word``.
    """
    joined = classed is not None
    table = _counted(train, vocabulary, of_word, width, joined)
    near = train.mapInArrow(lambda it: _contexts(it, vocabulary, of_word, slot, slots, width, joined), "word bigint, near binary")
    if joined:
        rare = int(of_word[-1])
        one = train.mapInArrow(lambda it: _open(it, vocabulary), "word bigint, near binary").join(classed.select("word", "class"), "word", "left").select(F.coalesce("class", F.lit(rare)).alias("class"), "near")
        both = train.mapInArrow(lambda it: _open_pairs(it, vocabulary), "a bigint, b bigint")
        for side in ("a", "b"):
            both = both.join(classed.select(F.col("word").alias(side), F.col("class").alias(f"of_{side}")), side, "left")
        both = both.select("a", "b", F.coalesce("of_a", F.lit(rare)), F.coalesce("of_b", F.lit(rare)))
        beside = one.mapInArrow(lambda it: _beside_known(it, vocabulary, of_word, width), "word bigint, near binary").union(both.mapInArrow(lambda it: _beside_open(it, width), "word bigint, near binary"))
        beside = scratch.save(beside, name)
        for row in beside.where("word is null").select("near").toLocalIterator():  # one row a task, at most width² entries
            entry = np.frombuffer(row.near, np.uint32).reshape(-1, 2)
            np.add.at(table.reshape(-1), entry[:, 0].astype(np.int64), entry[:, 1])
        near = near.union(beside.where("word is not null"))
    return table, near


def _fit(train: DataFrame, vocabulary: Vocabulary, scratch: Scratch, assigned: int, rounds: int, clustered: int, classes: int) -> tuple[Classes, DataFrame]:
    """Classes of known words, and ``(word, n, class)`` of all words of the training texts."""
    size = len(vocabulary.word)
    octave = np.floor(np.log2(np.maximum(vocabulary.count, 1))).astype(np.int64)
    octaves = int(octave.max()) + 1 if size else 0
    end = vocabulary.find(np.array([END]))[0]
    # Symbols: the most frequent words, then octaves, END, and all other words.
    symbol = np.append(np.where(vocabulary.rank < clustered, vocabulary.rank, clustered + octave), clustered + octaves + 1)
    symbol[end] = clustered + octaves
    symbols = clustered + octaves + 2
    counts = _counted(train, vocabulary, symbol, symbols)
    own = exchange(counts, clustered, classes)
    width = classes + octaves + 2
    member = np.zeros((symbols, width))
    member[np.arange(symbols), own] = 1
    table = member.T @ counts @ member
    del counts, member
    around = own[symbol]  # of each known word as a neighbour; the last is that of all others
    slot = np.append(np.where(vocabulary.rank < assigned, vocabulary.rank, -1), -1)
    chosen = around
    for k in range(max(1, rounds)):
        if k:
            # All words seen more than once are known, or the others' classes are joined.
            table, near = _surroundings(train, vocabulary, chosen, slot, assigned, classes + 2, classed if vocabulary.least > 2 else None, scratch, f"beside{k}")
        else:
            near = train.mapInArrow(lambda it: _contexts(it, vocabulary, around, slot, assigned, width, False), "word bigint, near binary")
        # The gain of a word's move, but for what it changes in its own class's sums.
        smooth = table[:classes] + 0.1
        ahead = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
        smooth = table[:, :classes] + 0.1
        behind = np.log(smooth / smooth.sum(axis=0, keepdims=True))
        classed = near.repartition("word").sortWithinPartitions("word").mapInArrow(lambda it, behind=behind, ahead=ahead: _assign(it, behind, ahead), "word bigint, n bigint, class int")
        classed = scratch.save(classed, f"classed{k}")
        if k:
            scratch.drop(f"classed{k - 1}", f"beside{k}")
        top = classed.where(F.col("n") >= vocabulary.least).select("word", "class").toArrow()
        at = vocabulary.find(top["word"].to_numpy())
        chosen = np.full(size + 1, classes + 1)
        chosen[at[at >= 0]] = top["class"].to_numpy()[at >= 0]
        chosen[end] = classes
    mass = np.zeros(classes + 2, np.int64)
    if size:
        mass[classes] = vocabulary.count[end]
    for r in classed.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] += r.n
    emission = np.append(np.log10(vocabulary.count / np.maximum(mass[chosen[:-1]], 1)), 0.0)
    return Classes(vocabulary, chosen, emission, mass, classes), classed


def _smoothed(table: np.ndarray) -> np.ndarray:
    """log10 of class transitions, Witten-Bell smoothed."""
    width = len(table)
    prior = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * width)
    follow = table.sum(axis=1, keepdims=True)
    different = np.count_nonzero(table, axis=1)[:, None]
    return np.log10(np.where(follow > 0, (table + different * prior) / np.maximum(follow + different, 1), prior))
