"""Fill-in-middle, line dedup and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations, fim, line_dedup

DOCS = "doc_id bigint, text string, lang string, `a b` string, `a.b` string, `x:y` string, `q``t` string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "1", "2", "3", "4") for i, t, lang in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle


def fim_rows():
    rng = random.Random(2)
    line = lambda: "".join(rng.choice("ab é<PSM>\r\t𝄞") for _ in range(rng.randint(0, 9)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 8))) + rng.choice(["", "\n"]) for _ in range(300)]
    texts += [None, "", "\n", "\n\n\n", "one", "has <P> in it", "<S>", "x<M>", "<<P", "a<\nb<\n>c\n", "ends <", "long line\n" * 50_000, "x" * 300_000]
    return [*enumerate(texts), (None, "a\nb\n"), (3, "same id\nother text"), (4, texts[4])]


def cut(text, name, seed=7, rate=100, spm=50, unit=fim.LINES):
    units = re.findall(unit, text)
    d = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return text, len(units), "plain", None, None
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return out, len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle)


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (60, 100), (0, 50)])
def test_fill_in_middle(spark, monkeypatch, rate, spm):
    rows = fim_rows()
    table = docs(spark, [(i, t, "n") for i, t in rows]).withColumnRenamed("lang", "form")
    made = fim.fill_in_middle(table, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "a b", "a.b", "x:y", "q`t", "output", "n", "form", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(i, *cut(t or "", "" if i is None else i, rate=rate, spm=spm), t or "") for i, t in rows]
    assert sorted(((r.doc_id, r.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.back) for r in got), key=key) == sorted(want, key=key)
    assert len({r.form for r in got}) > (1 if rate else 0)
    assert fim.fill_in_middle(table.limit(0)).count() == 0


def test_matcher_stores_no_units_and_takes_any_pattern():
    text = "ab, cd; ef gh"
    word = re.compile(r"\w+")
    assert [fim.cut_points(text, word, a, b) for a, b in ((0, 0), (0, 1), (1, 3), (4, 4))] == [(0, 0), (0, 2), (2, 10), (13, 13)]
    out, n, form, a, b = fim.transformed(text, "1", word, 7, 100, 0, fim.SENTINELS)
    assert (n, form) == (4, "psm") and out.count("<M>") == 1 and len(out) == len(text) + 9


@pytest.mark.parametrize("marks", [("<P>", "<S>"), ("<P>", "", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<S>", "<M")])
def test_sentinels_that_cannot_be_taken_apart(marks):
    if marks == ("<P>", "<S>", "<M"):
        fim.check_sentinels(marks)
    else:
        with pytest.raises(ValueError):
            fim.check_sentinels(marks)


# Line dedup


def line_rows(seed=5):
    rng = random.Random(seed)
    common = [f"Common line {k}" for k in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice([rng.choice(common), f" {rng.choice(common).upper()}\t", f"own {rng.random()}", "", "  ", "é", "a"]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, f"shared by nine\nown {i}") for i in range(9)] + [(300 + i, f"shared by ten \nown {i}\r\nShared By TEN") for i in range(10)]
    rows += [(400, "hot\n" * 3000), (401, None), (402, ""), (403, "\n"), (404, "\x85nbsp\x85\n\x0bnbsp\x0c")]
    rows += [(500 + i, "HOT\nrest") for i in range(400)] + [(None, "hot\nno id"), (None, "hot\nno id"), (None, "hot\nother"), (7, "hot\nsecond text of seven")]
    return [*rows, rows[3], rows[3]]


def key_of(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def brute_lines(rows, least, chars, first_stays):
    """Kept text, lines and dropped lines of each different (id, text)."""
    different = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    holders = defaultdict(set)
    for r in different:
        for line in r[1].split("\n"):
            holders[key_of(line)].add(r)
    out = {}
    met = set()
    for r in different:
        kept = []
        for line in r[1].split("\n"):
            k = key_of(line)
            if len(k) < chars or len(holders[k]) < least or first_stays and k not in met:
                kept.append(line)
            met.add(k)
        out[r] = ("\n".join(kept), len(r[1].split("\n")), len(r[1].split("\n")) - len(kept))
    return out


@pytest.mark.parametrize("least,chars,first_stays", [(10, 1, False), (2, 3, False), (1, 0, False), (2, 1, True), (10, 1, True)])
def test_line_dedup(spark, least, chars, first_stays):
    rows = line_rows() if not first_stays else [r for r in line_rows() if r[0] not in (None, 7)]  # ids of several texts stand in order of a hash
    table = docs(spark, [(i, t, "n") for i, t in rows]).withColumnRenamed("lang", "n_lines")
    bitmaps = line_dedup.line_keep_bitmaps(table, min_docs=least, min_chars=chars, first_stays=first_stays)
    want = brute_lines(rows, least, chars, first_stays)
    got = bitmaps.collect()
    assert len(got) == len(want)
    for r in got:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8))
        assert r.n_lines - bits[: r.n_lines].sum() == r.n_dropped and not bits[r.n_lines :].any()
    kept = line_dedup.kept_lines(table, bitmaps)
    assert kept.columns == ["doc_id", "text", "a b", "a.b", "x:y", "q`t", "n_lines", "n_dropped"]
    found = Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in kept.collect())
    assert found == Counter((i, *want[(i, t or "")]) for i, t in rows)


@pytest.mark.parametrize("cut_at", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_streamed_range_whatever_the_batches(cut_at, least):
    """One key after another, cut into batches anywhere: decided lines, lines left open and counts at both ends."""
    import pyarrow as pa

    rng = random.Random(cut_at * 10 + least)
    rows = sorted((rng.randint(1, 9), rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 1), p) for p in range(60)) if False else sorted(((rng.randint(1, 9), rng.randint(1, 4), rng.randint(0, 1), p) for p in range(60)))
    columns = [pa.array([5] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32())))]
    whole = pa.RecordBatch.from_arrays(columns, ["part", "h", "id", "text_hash", "pos"])
    out = [r for b in line_dedup._judged((whole.slice(i, cut_at) for i in range(0, len(rows), cut_at)), least, False) for r in b.to_pylist()]
    held = defaultdict(set)
    for h, i, t, _ in rows:
        held[h].add((i, t))
    first, last = rows[0][0], rows[-1][0]
    gone = {r[3] for r in rows if len(held[r[0]]) >= least and r[0] != first}
    assert {r["pos"] for r in out if r["kind"] == line_dedup.DROP} == gone
    waiting = {r[3] for r in rows if r[0] == first or r[0] == last and len(held[last]) < least}
    assert {r["pos"] for r in out if r["kind"] == line_dedup.OPEN} == waiting
    assert {r["h"]: r["docs"] for r in out if r["kind"] == line_dedup.EDGE} == {h: len(held[h]) for h in (first, last)}


def test_line_dedup_of_nothing(spark):
    empty = docs(spark, [(1, "a", "b")]).limit(0)
    bitmaps = line_dedup.line_keep_bitmaps(empty)
    assert bitmaps.count() == 0 and line_dedup.kept_lines(empty, bitmaps).count() == 0


# Collocations


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "Été", "été", "x-y", "ça", "über", "<p>", "𝄞"]
    rows = []
    for i in range(260):
        parts = [rng.choice(["New York city hall", "new\tyork  City", "the the the the", "of the", rng.choice(words), f"rare{i}", "aa ab", "Aa ac"]) for _ in range(rng.randint(0, 14))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", ". ", ";", "!\r\n", "\x0b", "\x85"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (900, None, "en"), (901, "", None), (902, " \t.;", "en"), (903, "loop " * 3000, "hot"), (904, "one two\n" * 40, "few"), rows[5], rows[5], (None, rows[6][1], "en")]


def brute_phrases(rows, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {q[i : i + m] for q, a in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= cover * counts[q[i : i + m]]}
        rows_ = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,cover,top,words,block", [(30, 80, 2000, 4_000_000, 1_000_000), (3, 80, 25, 5, 50), (1, 100, 2000, 1000, 7), (2, 50, 3, 11, 1000)])
def test_collocations(spark, monkeypatch, least, cover, top, words, block):
    """Also with a dictionary of several slices and small blocks of keys."""
    monkeypatch.setattr(collocations, "SLICE_WORDS", words)
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows).withColumns({"hi": F.lit(1), "id": F.lit(2), "n": F.lit(3)}), min_count=least, cover=cover, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, cover, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, [(1, "a b", "c")]).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None)]), min_count=1).count() == 0


def test_radix_order_and_run_lengths():
    import pyarrow as pa

    rng = np.random.RandomState(4)
    a, b = rng.randint(1, 4, 500).astype(np.uint64) << np.uint64(32) | rng.randint(1, 3, 500).astype(np.uint64), rng.randint(0, 2**40, 500).astype(np.uint64)
    order = collocations.radix_order(a, b)
    assert [(a[i], b[i]) for i in order] == sorted(zip(a, b))
    third = rng.randint(0, 3, 500).astype(np.int64)
    lo = third << 32 | np.where(third > 0, rng.randint(0, 3, 500), 0)
    rows = sorted(zip(a.astype(np.int64), lo, rng.randint(1, 5, 500)))
    want = [Counter(), Counter(), Counter()]
    for h, x, n in rows:
        want[0][(h, 0)] += n
        if x >> 32:
            want[1][(h, x >> 32 << 32)] += n
        if x & 0xFFFFFFFF:
            want[2][(h, x)] += n
    for size in (1, 3, 64, 1000):
        parts = (pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows[i : i + size])], ["hi", "lo", "n"]) for i in range(0, len(rows), size))
        found = Counter()
        for out in collocations._run_lengths(parts, 1):
            for r in out.to_pylist():
                found[(r["hi"], r["lo"])] += r["f"]
        assert found == want[0] + want[1] + want[2]
