"""Each operator against brute force, on small tables with nulls, ties, repeats, empties and clashing names."""

import gzip
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import base_scores, components, fold, leaks, repeats, words
from pyspark.sql import functions as F

from tidewell.llm import brown, decontaminate, html_text, jaccard, langid, mixing, oracles, queries, suffixes, urls, vptree, warc
from tidewell.llm.components import components as connected
from tidewell.llm.scratch import Scratch
from tidewell.llm.words import slices, windows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, size bigint, id bigint"


def docs(spark, rows):
    """Rows of (id, text[, lang, source]), with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), None, 1, 2, 3) for r in rows], DOCS)


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def text(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def families(seed=1):
    """Originals, exact and near copies, texts that share a passage, and odd rows."""
    rng, vocab = random.Random(seed), vocabulary(seed)
    passage = text(rng, vocab, 70)
    rows, i = [], 0
    for _ in range(6):
        base = text(rng, vocab, rng.choice([3, 40, 150, 300])).split()
        for edits in (0, 0, 1, 2, 5, 12):
            w = list(base)
            for _ in range(min(edits, len(w) // 10)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            rows.append((i, " ".join(w)))
            i += 1
    for _ in range(80):
        rows.append((i, f"{text(rng, vocab, 40)} {passage} {text(rng, vocab, rng.choice([5, 20, 60]))}"))
        i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "One"), (i + 4, "ONE"), (i + 5, "a b c d e"), (i + 6, "word " * 5000)]


def test_components_of_chain_and_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert len({got[i] for i in range(100, 140)}) == 1
    assert connected(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hot", [64, 5])
def test_jaccard_components(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = families()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == components(dict(rows))


def exposed_pair():
    """Two texts at 75 %, and filler that makes groups of 24 of their signatures hot, 8 of them of one text only."""
    rng, vocab = random.Random(11), vocabulary(11, 3000)
    w = text(rng, vocab, 68).split()
    a, b = " ".join(w[:52]), " ".join(w)
    part = next(slices(pa.array([a, b])))
    value, bounds = jaccard.feature_sets(part, 5)
    gram, of, first = windows(part, 5)
    own = [{int(g): w[p : p + 5] for g, t, p in zip(gram, of, first) if t == k} for k in (0, 1)]
    found = [set(), set()]
    for sig, node, need in jaccard.signatures(value, bounds, 75):
        for x, k, n in zip(sig.tolist(), node.tolist(), need.tolist()):
            if n == 17:
                found[k].add(x)
    name = {int(jaccard.mix(jaccard.mix(np.array([g], jaccard.U) ^ jaccard.U(0x5851F42D4C957F2D)) + np.array([g], jaccard.U) + jaccard.U(3 << 40))[0]): g for g in own[1]}
    both = [name[x] for x in sorted(found[0] & found[1])][:16]
    only = [name[x] for x in sorted(found[1] - found[0])][:8]
    return a, b, [own[1][g] for g in both + only]


@pytest.mark.parametrize(("hot", "fillers"), [(64, 70), (2, 4)])
def test_jaccard_keeps_links_of_sets_with_hot_groups(spark, monkeypatch, hot, fillers):
    monkeypatch.setattr(jaccard, "HOT", hot)
    a, b, grams = exposed_pair()
    assert len(grams) == 24
    rng, vocab = random.Random(12), vocabulary(12, 5000)
    rows = [(0, a), (1, b)] + [(2 + i, f"{text(rng, vocab, 20)} {' '.join(grams[i % 24])} {text(rng, vocab, 23)}") for i in range(24 * fillers)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got[1] == (64, 0)
    assert got == components(dict(rows))


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard_sets_of_common_passages(spark, monkeypatch, hot):
    """Texts put together from a few passages, with own words, consist almost only of hot features."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng, vocab = random.Random(13), vocabulary(13, 3000)
    passages = [text(rng, vocab, 40) for _ in range(5)]
    rows = []
    for i in range(160):
        mine = [p for p in passages if rng.random() < 0.7]
        rows.append((i, f"{' '.join(mine)} {text(rng, vocab, rng.choice([0, 1, 3, 8, 15, 30]))}"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, rows), rounds=0).collect()}
    assert got == components(dict(rows))


def test_jaccard_deals_heavy_groups_to_many_tasks(spark, monkeypatch):
    """Groups known as heavy beforehand: their rows are those of the plain windows, though no window holds a group whole."""
    monkeypatch.setattr(jaccard, "HOT", 5)
    rows = [(s, n, 1) for s in range(12) for n in range(2 * s)] * 2 + [(50, 1, 1)]
    df = spark.createDataFrame(rows, "sig bigint, node bigint, need int")
    plain, dealt = (sorted(map(tuple, jaccard._shared(df, spark.createDataFrame([(s,) for s in heavy], "sig bigint")).collect())) for heavy in ([], range(3, 12)))
    assert plain == dealt == sorted((s, n, 1, 2 * s > 5) for s in range(1, 12) for n in range(2 * s))
    monkeypatch.setattr(jaccard, "HEAVY_SHARE", 1)
    texts = families(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, texts)).collect()} == components(dict(texts))


def test_jaccard_odd_tables(spark):
    assert jaccard.ngram_jaccard_join(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.ngram_jaccard_join(docs(spark, rows)).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("None", 2, "1")]


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/de/ok")]


def test_url_filter(spark):
    pages = [
        (1, "https://A.Example.org/es/x?q#f", None),
        (2, "http://b.org/y", "<p>"),
        (3, "http://x.net/a#t", "<LINK rel='canonical' href='/b?c=1&amp;d=2'>"),
        (4, "http://x.net/b?c=1&d=2", '<meta http-equiv="refresh" content="0; url=https://q.com/de/1">'),
        (5, "http://y.net/a", '<link href="http://z.org/" rel="canonical">'),
        (6, "nothing", None), (7, None, None), (8, "http://q.com", ""), (8, "http://q.com", ""), (9, "https://com/de/ok", None),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, host string, node string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df, RULES).orderBy("page_id").collect()]
    assert got == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "b.org", "/y", "org/", "allow"), (3, "x.net", "/a", None, "block"), (4, "x.net", "/b", None, "block"),
        (5, "y.net", "/a", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "q.com", "", None, "allow"), (8, "q.com", "", None, "allow"), (9, "com", "/de/ok", "com/de/ok", "allow"),
    ]
    more = spark.createDataFrame([("http://y.net/a", "https://q.com/de/1"), ("http://q.com", "https://q.com/de/2")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in urls.url_filter(df, RULES, redirects=more).collect()}
    assert (got[5], got[3], got[8]) == ("allow", "allow", "block")
    assert urls.url_filter(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize("compiled", [50, 0])
def test_url_filter_on_linked_pages_against_sql(spark, tmp_path, monkeypatch, compiled):
    """A few hundred pages with all kinds of links, by the query's SQL."""
    monkeypatch.setattr(urls, "COMPILED_RULES", compiled)
    rng = random.Random(16)
    hosts = ["a.example.org", "example.org", "x.com", "Y.com", "b.net", "c.net", "org", "sub.b.net"]
    paths = ["", "/", "/es/1", "/en/12", "/en/2", "/fr/a", "/de/b", "/q/r/s", "/q/r/t?u=1"]
    url = lambda: f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice([*hosts, *(f'p{rng.randrange(300)}.net' for _ in range(20))])}{rng.choice(paths)}{rng.choice(['', '#f'])}"
    link = lambda: rng.choice([url(), url(), rng.choice(paths), "../de/b", "../../fr/a", "./s", "t", "..", "mailto:x", "//x.com/de/b", "?q=1&amp;r=2", "a/./b/../c"])
    make = [
        lambda: f'<link rel="canonical" href="{link()}">', lambda: f"<LINK data-href='/no' HREF='{link()}' rel=canonical>", lambda: f'<meta http-equiv=refresh content="0;url={link()}">',
        lambda: f'<meta http-equiv="Refresh" content="3; URL={link()}"><link rel="canonical" href="{link()}">', lambda: "<p>canonical</p>", lambda: None,
    ]
    rows = [(i, rng.choice([url(), url(), url(), url(), None, "no url"]), rng.choice(make)()) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages")
    want = duckdb.sql(oracles.URLS.replace("FROM pages", f"FROM '{tmp_path}/pages/*.parquet'")).fetchall()
    got = [tuple(r) for r in urls.url_filter(df, queries.URL_RULES).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[3] is None and r[4] == "block" for r in got) > 2
    many = spark.createDataFrame([(v, h, p) for v, h, p in queries.URL_RULES] + [("block", f"h{i}.com", "/") for i in range(2000)], "verdict string, host string, path string")
    assert sorted(map(str, (tuple(r) for r in urls.url_filter(df, many).collect()))) == sorted(map(str, want))


def test_repeated_passages(spark):
    rows = [*families(3), (None, "x y z " * 40), (900, "x y z " * 30), (901, "p q " * 60)]
    want = repeats(rows)
    got = {r.doc_id: (r.n_repeated, r.n_removed, [x for x in r.first_ids if x is not None]) for r in suffixes.passage_report(docs(spark, rows)).collect()}
    assert got == want
    left = suffixes.remove_repeats(docs(spark, rows))
    kept = left.collect()
    assert left.columns == docs(spark, []).columns
    assert sum(len(words(r.text)) for r in kept) == sum(len(words(t)) for _, t in rows) - sum(w[1] for w in want.values())
    assert {r.doc_id for r in kept if r.text is None} == {i for i, t in rows if t is None}
    assert suffixes.passage_report(docs(spark, [])).count() == 0


def test_columns_with_clashing_names(spark):
    rows = families(3)[:60]
    odd = "items,hit_words,n_words,name,block,_name,_hits,_items,_sha,_spans,_i,_t,spans,rest,cut,first_ids,t,pos,head,segment,run,a b".split(",")
    df = docs(spark, rows).withColumns({c: F.lit(c) for c in odd}).withColumn("doc_id", F.col("doc_id").cast("int"))
    items = spark.createDataFrame([(1, rows[0][1]), (2, rows[50][1])], "item_id bigint, text string")
    want = leaks(dict(rows), [(1, rows[0][1]), (2, rows[50][1])])
    for block in (200_000, 40):
        got = decontaminate.find_contamination(df, items, block_patterns=block)
        assert set(got.columns) == {*df.columns} - {"text"}
        assert {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in got.collect()} == want
    left = suffixes.remove_repeats(df)
    assert left.columns == df.columns
    gone = repeats(rows)
    assert all(r[c] == c for r in left.collect() for c in odd)
    assert sum(len(words(r.text)) for r in left.collect()) == sum(len(words(t)) for _, t in rows) - sum(w[1] for w in gone.values())


@pytest.mark.parametrize("window", [1, 2, 3, 10, 300])
def test_decontamination_windows_and_long_texts(spark, window):
    rng, vocab = random.Random(9), ["aa", "b", "c", "dd", "é"]
    items = [(k, text(rng, vocab, n)) for k, n in enumerate([window, window + 5, 2 * window, max(1, window - 1), 700])]
    rows = [(k, f"{text(rng, vocab, 40)} {items[k % 5][1]} {text(rng, vocab, 300)}") for k in range(20)] + [(50, f"{text(rng, vocab, 20000)} {items[4][1]} zz")]
    found = decontaminate.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), window=window).collect()
    assert {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in found} == leaks(dict(rows), items, window)


def test_search_skips_most_words():
    rng, vocab = random.Random(10), vocabulary(10, 5000)
    runs = [" ".join(vocab[i : i + 10]) for i in range(0, 1000, 10)]
    table = decontaminate.build([(0, r) for r in runs])[0]
    part = next(slices(pa.array([text(rng, [f"x{i}" for i in range(5000)], 20000)])))
    looked = []
    real = decontaminate._block
    decontaminate._block = lambda words_, end, length: looked.append(len(end)) or real(words_, end, length)
    try:
        decontaminate.possible_ends(part, table)
    finally:
        decontaminate._block = real
    assert sum(looked) < 20000 / 7


@pytest.mark.parametrize("seed", [21, 22])
def test_passages_shared_by_classes(spark, seed):
    """Passages that overlap in part, so that what one group of copies repeats occurs earlier in other surroundings."""
    rng, vocab = random.Random(seed), vocabulary(seed, 60)
    pool = [text(rng, vocab, n) for n in (60, 90, 75, 52, 130)]
    rows = []
    for i in range(120):
        words_ = rng.choice(pool).split()
        a, b = sorted((rng.randrange(len(words_)), rng.randrange(len(words_))))
        piece = " ".join(words_[a:b] if rng.random() < 0.5 else words_)
        rows.append((i, f"{text(rng, vocab, rng.choice([0, 1, 2, 40]))} {piece} {rng.choice([' ', rng.choice(pool), text(rng, vocab, 3)])}"))
    want = repeats(rows)
    got = {r.doc_id: (r.n_repeated, r.n_removed, r.first_ids) for r in suffixes.passage_report(docs(spark, rows)).collect()}
    assert got == want


def test_suffixes_that_match_none_are_shuffled_once(spark, monkeypatch):
    """Of texts with little in common only what two of them share goes on, and what is left of the rest is freed at once."""
    rng, vocab = random.Random(31), vocabulary(31, 900)
    rows = [(i, text(rng, vocab, 400)) for i in range(40)]
    rows += [(50, f"{text(rng, vocab, 90)} {' '.join(rows[3][1].split()[100:170])} {text(rng, vocab, 90)}"), (51, rows[5][1]), (None, rows[6][1])]
    saved, save = {}, suffixes.Scratch.save

    def counted(self, df, name):
        left = {k for k in saved if os.path.exists(self.path(k).removeprefix("file:"))}
        saved[name] = (save(self, df, name).count(), left)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    monkeypatch.setattr(suffixes.Scratch, "save", counted)
    got = {r.doc_id: (r.n_repeated, r.n_removed, [x for x in r.first_ids if x is not None]) for r in suffixes.passage_report(docs(spark, rows)).collect()}
    assert got == repeats(rows)
    assert saved["suffixes"][0] > 800
    assert saved["classes"][0] < saved["suffixes"][0] / 5
    assert "suffixes" not in saved["classes"][1]


def test_copies_that_fill_all_ranges(spark):
    """Three classes over four ranges, so that some lie across a border; rows equal in id and text, and null ids."""
    rng, vocab = random.Random(32), vocabulary(32, 300)
    words_ = [rng.choice(vocab) for _ in range(70)]
    copies = [(i, " ".join(words_)) for i in range(60)] + [(7, " ".join(words_)), (None, " ".join(words_)), (70, " ".join(words_[5:]))]
    got = {r.doc_id: (r.n_repeated, r.n_removed, [x for x in r.first_ids if x is not None]) for r in suffixes.passage_report(docs(spark, copies)).collect()}
    assert got == repeats(copies)


ARTICLE = "<p>First &eacute;t&eacute; words&nbsp;here of the <a href=x>story</a> told.</p><p>Second<br>para &amp; more.</p>"
OUTER = '<nav><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul></nav><div class="ad">Buy this</div>{}<aside>Side things</aside><section class="comments"><p>Nice one, thanks a lot for it</p></section><footer>&copy; me</footer>'
WANTED = "Title\nFirst été words here of the story told.\nSecond para & more."


@pytest.mark.parametrize("page", [
    OUTER.format(f"<article><h1>Title</h1>{ARTICLE}</article>"),
    OUTER.format(f"<main><h1>Title</h1>{ARTICLE}<form>Sign up <input></form></main>"),
    OUTER.format(f"<div class=content><h1>Title</h1><script>var a='<p>no</p>'</script>{ARTICLE}</div><div id=cookie-notice>We use cookies</div>"),
    OUTER.format(f"<article><h1>Title</h1>{ARTICLE.replace('told.</p>', 'told.</p><div class=advert>Great deal</div>')}"),
])
def test_html_extraction(spark, page):
    training = spark.createDataFrame([(OUTER.format(f"<article><h1>T {i}</h1>{ARTICLE}</article>"),) for i in range(5)], "html string")
    df = spark.createDataFrame([(1, page, "t", "x"), (2, None, "t", "x"), (3, "", "t", "x"), (4, "<p", "t", "x"), (4, "<p", "t", "x")], "page_id int, html string, text string, rest string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df, training=training).orderBy("page_id").collect()]
    assert got == [(1, WANTED, len(WANTED)), (2, "", 0), (3, "", 0), (4, "", 0), (4, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title></head><body><form id=form1><article>{}</article></form></body></html>",
        "<html><body><form><div><p>{}</p></div></form><footer>c</footer></body></html>",
        "<html><body><div class=sidebar><main>{}</main></div></body></html>",
        "<html><head><title>T</title><body><p>{}</p></body></html>",
        "<html><head><meta charset=utf-8><noscript>n<body><p>{}</p></body></html>",
        "<head><title>T</title><p>{}</p>",
        "<head><title>T</title>{}",
    ],
)
def test_html_text_in_wrappers(page):
    words_ = " ".join(["word"] * 40)
    assert html_text.main_text(page.format(words_), html_text.Weights()) == words_


def test_html_forms_and_hidden_parts_stay_outside():
    page = "<body><article>" + "word " * 40 + "<form>send this</form></article><div hidden><main>secret</main></div><aside class=related><article>other</article></aside></body>"
    assert html_text.main_text(page, html_text.Weights()) == ("word " * 40).strip()


def test_html_names_do_not_decide_alone():
    weights = html_text.learn([OUTER.format(f"<article><h1>T {i}</h1>{ARTICLE * 5}</article>") for i in range(20)])
    words_ = " ".join(["word"] * 40)
    assert html_text.main_text(f'<nav>a</nav><div id="social"><article>{words_}</article></div>', weights) == words_
    assert html_text.main_text(f'<article><p>{words_}</p><section id="related-work"><p>{words_}</p></section></article>', weights) == f"{words_}\n{words_}"
    assert html_text.main_text(f'<article><p>{words_} <span style="display:none">not seen</span>end</p></article>', weights) == f"{words_} end"
    # A name that is unknown to the priors is learnt from pages, one that is known is learnt anew.
    assert weights.of("ad") < -2 < 0 == weights.of("zzz")
    pages = [f"<article><div class=comment>{words_}</div></article><div class=zzz>{words_}</div>"] * 3
    assert html_text.learn(pages).of("comment") > 0 > html_text.learn(pages).of("zzz")


def test_best_stretch_against_all_ranges():
    rng = random.Random(17)
    for n in range(60):
        scores = [rng.choice([-3, -1, 0, 0.5, 1, 2]) * rng.random() for _ in range(n % 13)]
        want = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        i, j = html_text.best_stretch(scores)
        assert sum(scores[i:j]) == pytest.approx(max(0, want)) and (i < j) == (want > 0)


def test_scores_against_nested_elements():
    """Scores of a walk equal those summed afresh over each block's open elements, for random well-formed pages."""
    rng = random.Random(18)
    weights = html_text.Weights(0.3, {"x": -1.0, "y": 1.5, "<blockquote>": 0.25, "links:none": 0.1})

    def make(depth):
        """(tag, names, children) trees; a child that is None is a paragraph of three words."""
        return [(rng.choice(["div", "section", "blockquote"]), rng.choice(["x", "y", "z", "x y"]), make(depth - 1)) if depth and rng.random() < 0.7 else None for _ in range(rng.randint(1, 3))]

    def html_of(nodes):
        return "".join("<p>one two three</p>" if n is None else f'<{n[0]} class="{n[1]}">{html_of(n[2])}</{n[0]}>' for n in nodes)

    def size(nodes):
        return sum(3 if n is None else size(n[2]) for n in nodes)

    def wanted(nodes, around, total):
        out = []
        for n in nodes:
            if n is None:
                out.append(min(html_text.FOR, 0.3 + 0.1 + sum(weights.of(f) for f in around | {"<p>"})))
            else:  # names of what holds over eight tenths of the page don't count
                names = set() if 10 * size(n[2]) > 8 * total else set(n[1].split())
                out += wanted(n[2], around | {f"<{n[0]}>"} - {"<div>", "<section>"} | names, total)
        return out

    for _ in range(30):
        nodes = make(5)
        got = [w for _, w, _ in html_text.scored(html_of(nodes), weights)]
        assert got == pytest.approx(wanted(nodes, set(), size(nodes)))


def test_html_time_is_linear_in_nesting():
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text("".join(f"<div class=c{i}><b>w" for i in range(n)), html_text.Weights())
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 5 + 12 * seconds(4_000)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, block):
    rng, vocab = random.Random(5), vocabulary(5)
    items = [(k, text(rng, vocab, n)) for k, n in enumerate([30, 12, 10, 9, 3, 1])] + [(6, None), (7, "!!"), (None, text(rng, vocab, 15)), (8, "des Été 7")]
    rows = [(k, f"{text(rng, vocab, 30)} {' '.join(words(items[k % 10][1])[: rng.choice([5, 12, 40])])}. {text(rng, vocab, 8)}") for k in range(60)] + [(60, None), (61, ""), (62, "x, DES été-7!"), (63, "w " * 30000)]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id bigint, text string, run string")
    got = {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in decontaminate.find_contamination(docs(spark, rows), bench, block_patterns=block).collect()}
    assert got == leaks(dict(rows), items)
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0
    assert {r.hit_words == [] for r in decontaminate.find_contamination(docs(spark, rows), bench.limit(0)).collect()} == {True}


def test_mixing(spark):
    rng, vocab = random.Random(2), vocabulary(2)
    rows = [(i, text(rng, vocab, rng.randint(1, 30)), "en", rng.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(600)]
    rows += [(1000, None, "en", "tiny"), (1001, "one two", "en", "tiny"), (1002, "", "en", "none")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    # Water filling by hand.
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    target, open_ = dict.fromkeys(sources, 0.0), set(sources)
    while True:
        rest = total - sum(3 * sources[s][0] for s in sources if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sources[s][0]}
        if not over:
            break
        open_ -= over
    target = {s: level * weight[s] if s in open_ else 3 * sources[s][0] for s in sources}
    for s, (_, t) in sources.items():
        assert t == pytest.approx(target[s])
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - t) < len(sources)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == total
    # The schedule by hand: every copy's finish time, sorted, cut at the budget.
    pieces = []
    for s, (size, t) in sources.items():
        mine = sorted(((hashlib.md5(str(i).encode()).hexdigest(), i, len(words(x))) for i, x, _, o in rows if o == s))
        at = 0
        for copy in range(3):
            for _, i, n in mine:
                if n and at < t:
                    first = max(0, min(n, math.floor(t) - at))
                    whole = (at + n) / t
                    pieces += [p for p in ((whole if first == n else 1.0, s is None, s or "", at, i, copy, first), (whole, s is None, s or "", at, i, copy, n - first)) if p[-1]]
                at += n
    at, mix = 0, []
    for finish, _, s, _, i, copy, n in sorted(pieces):
        if at < total:
            mix.append((i, s or None, copy, finish, min(n, total - at), at))
        at += n
    assert [tuple(r) for r in mixing.mix_schedule(docs(spark, rows)).orderBy("at").collect()] == mix
    taken = {r.doc_id: r.taken for r in got}
    assert all(taken[i] == sum(p[4] for p in mix if p[0] == i) for i, *_ in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs(spark, rows).repartition(7)).collect()))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nx" * 40
    pages = [(1, "http://a/ b\r\nX: y", "é" * 600), (2, None, "é" * 600), (3, "u", "short"), (4, "u", "short"), (5, "u", tricky), (6, "u", tricky), (7, "u", None), (None, "u", "é" * 600), (8, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id bigint, url string, html string, payload_digest string")
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        to = max(same) if len(raw) >= 1000 and i is not None and max(same) != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    payload = {r.id: r.payload for r in warc.warc_round_trip(df).collect()}
    assert payload[6] == tricky.encode() and payload[5] is None
    assert warc.warc_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [1 << 20, 3, 1])
def test_warc_records_and_responses(spark, tmp_path, monkeypatch, slots):
    monkeypatch.setattr(warc, "SLOTS", slots)
    rng, vocab = random.Random(6), vocabulary(6)
    bodies = [text(rng, vocab, rng.choice([2, 250, 400])) for _ in range(20)]
    pages = [(i, "u", bodies[rng.randrange(20)]) for i in range(150)] + [(7, "u", "q " * 700), (7, "u", "q " * 700), (None, "u", bodies[0])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path).collect()
    most = {h: max(i for i, _, g in pages if g == h and i is not None) for _, _, h in pages}
    want = [(i, len(h), "revisit", most[h]) if len(h) >= 1000 and i is not None and i != most[h] else (i, len(h), "response", None) for i, _, h in pages]
    assert sorted(((r.id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    # Every record is a gzip member of its own.
    members = 0
    for f in tmp_path.glob("a/*.warc.gz"):
        data = f.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            record = d.decompress(data)
            assert d.eof and record.startswith(b"WARC/1.0\r\n") and record.count(b"WARC-Type: ") == 1
            data, members = d.unused_data, members + 1
    assert members == len(pages)


def test_warc_filter_tells_most_responses(spark):
    """It holds every revisit and about one other page in 400, whatever their number is."""
    every = spark.range(40_000).select("id", F.sha1(F.col("id").cast("string").cast("binary")).alias("payload_digest"))
    for n in (20_000, 300, 0):
        met, hit = warc._met(every, every.where(F.col("id") < n), 0)
        own, others = met.agg(F.count_if(hit & (F.col("id") < n)), F.count_if(hit & (F.col("id") >= n))).first()
        assert own == n and others < 0.006 * (40_000 - n)


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def record(kind, rid, block, more=b"", version=b"1.1"):
        return b"WARC/" + version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:" + rid + b">\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    info = record(b"warcinfo", b"1", b"software: x\r\n", b"Content-Type: application/warc-fields\r\n")
    page = record(b"response", b"2", http + b"body \r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n end", b"Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a/\r\n", b"1.0")
    cut = record(b"response", b"3", http + b"x" * 500, b"Content-Type: application/http\r\n")[:-300]
    (tmp_path / "a.warc").write_bytes(info + page + cut)
    (tmp_path / "b.warc").write_bytes(page)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    got = sorted((r.record_id[-2], r.record_type, bytes(r.payload), r.cut, r.id) for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    body = b"body \r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n end"
    assert got == [("1", "warcinfo", b"software: x\r\n", False, None)] * 2 + [("2", "response", body, False, None)] * 3 + [("3", "response", b"x" * 204, True, None)]


def test_brown_scores(spark):
    rng = random.Random(4)
    parts = [vocabulary(k, 150) for k in range(3)]
    rows = [(i, text(rng, parts[i % 3], rng.randint(5, 60))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x " * 20000)]
    got = brown.class_model_scores(docs(spark, rows), known=120, assigned=60, clustered=40, classes=8).collect()
    want = base_scores(dict(rows))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert brown.class_model_scores(docs(spark, [])).count() == 0
    twice = brown.class_model_scores(docs(spark, [(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert len(twice) == 3


@pytest.mark.parametrize("known", [10_000, 50])
def test_brown_scores_against_dictionaries(spark, monkeypatch, known):
    """Given the classes found, every text's score from plain counts of class pairs and words."""
    kept = {}
    real = brown._fit
    monkeypatch.setattr(brown, "_fit", lambda *a: kept.setdefault("fit", real(*a)))
    rng, vocab = random.Random(19), vocabulary(19, 120)
    weight = [1 / (i + 1) for i in range(120)]
    rows = [(i, " ".join(rng.choices(vocab, weight, k=rng.randint(0, 40)))) for i in range(150)] + [(900, None), (901, "never seen words " * 3)]
    got = {r.doc_id: r for r in brown.class_model_scores(docs(spark, rows), known=known, assigned=30, clustered=20, classes=5).collect()}
    fitted, classed = kept["fit"]
    table = {r.word: r["class"] for r in classed.collect()}
    end, other = fitted.end, fitted.end + 1
    name = {w: int(brown._tokens(next(slices(pa.array([w]))))[0][0]) for _, t in rows for w in words(t)}
    train = Counter(w for i, t in rows if fold(i, 5) != 1 for w in words(t))
    assert set(table) == {name[w] for w in train}
    of = lambda w: end if w is None else table[name[w]] if train[w] > 1 else other
    assert {table[name[w]] for w in train if train[w] == 1} <= {other} and {of(w) for w in train if train[w] > 1} <= set(range(5))
    mass, pairs = Counter(), Counter()
    for i, t in rows:
        if fold(i, 5) != 1:
            seq = [end, *(of(w) for w in words(t)), end]
            pairs.update(zip(seq, seq[1:]))
            mass.update(seq[1:])
    kinds, follow, ahead = Counter(a for a, _ in pairs), Counter(), Counter()
    for (a, b), n in pairs.items():
        follow[a] += n
        ahead[b] += n
    width = fitted.end + 2
    total = sum(pairs.values())

    def step(a, b):
        prior = (ahead[b] + 0.5) / (total + 0.5 * width)
        return (pairs[a, b] + kinds[a] * prior) / (follow[a] + kinds[a]) if follow[a] else prior

    def word(w):
        if w is None:
            return 1.0
        return train[w] / mass[of(w)] if train[w] > 1 else (train[w] + 0.5) / (mass[other] + 0.5 * (mass[other] + 1))

    for i, t in rows:
        tokens = [*words(t), None]
        want = sum(math.log10(step(a, b)) for a, b in zip([end, *map(of, tokens)], map(of, tokens))) + sum(math.log10(word(w)) for w in tokens)
        assert got[i].score == pytest.approx(want), i
        assert got[i].perplexity == pytest.approx(10 ** (-want / len(tokens)))


def test_brown_classes_of_rare_words(spark):
    # Words of two kinds alternate. All but 20 of 120 are beyond the sent table and still have classes.
    rng = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "ab"]
    weight = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(kinds[j % 2], weight)[0] for j in range(30))) for i in range(3000) if fold(i, 5) != 1]
    held = [i for i in range(3000, 3100) if fold(i, 5) == 1][:10]
    right, wrong = held[:5], held[5:]
    for n, i in enumerate(right):
        a, b, c, d = kinds[0][40 + n], kinds[1][40 + n], kinds[0][50 + n], kinds[1][50 + n]
        rows += [(i, f"{a} {b} {c} {d}"), (wrong[n], f"{a} {c} {b} {d}")]
    got = {r.doc_id: r for r in brown.class_model_scores(docs(spark, rows), known=20, assigned=5, clustered=12, classes=4).collect()}
    for i, j in zip(right, wrong):
        assert got[i].base_score == pytest.approx(got[j].base_score) and got[i].n_known == 5
        assert got[i].score > got[j].score + 0.3
    assert brown.grown(50_000, 600, 40) == (600, 40) and brown.grown(6_400_000, 600, 40) == (2400, 80)


@pytest.mark.parametrize("known", [10_000, 40, 0])
def test_brown_surroundings_against_dictionaries(spark, known):
    """Classes beside every word, and class pairs, whatever part of the words is sent with the tasks."""
    rng, vocab = random.Random(23), vocabulary(23, 120)
    weight = [1 / (i + 1) for i in range(120)]
    texts = [" ".join(rng.choices(vocab, weight, k=rng.randint(0, 40))) for _ in range(150)] + ["", "once only words", None, "rare " * 3]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    name = {w: int(brown._tokens(next(slices(pa.array([w]))))[0][0]) for t in texts for w in words(t)}
    count, classes = Counter(w for t in texts for w in words(t)), 5
    of = {w: rng.randrange(classes) if n > 1 else classes + 1 for w, n in count.items()} | {None: classes}
    counts = spark.createDataFrame([(name[w], n) for w, n in count.items()] + [(brown.END, len(texts))], "word bigint, n bigint")
    found = brown._known(counts, known)
    assert (found.least > 2) == (known < 10_000)
    by_name = {name[w]: of[w] for w in count} | {brown.END: classes}
    of_word = np.array([by_name[w] for w in found.word.tolist()] + [classes + 1])
    slot = np.append(np.where(found.rank < 15, found.rank, -1), -1)
    classed = spark.createDataFrame([(name[w], of[w]) for w in count], "word bigint, class int") if found.least > 2 else None
    table, near = brown._surroundings(train, found, of_word, slot, 15, classes + 2, classed, Scratch(spark, "t"), "beside")
    width, want, want_near = classes + 2, Counter(), Counter()
    for t in texts:
        seq = [None, *words(t), None]
        for a, b in zip(seq, seq[1:]):
            want[of[a], of[b]] += 1
            if b is not None:
                want_near[name[b], "before", of[a]] += 1
            if a is not None:
                want_near[name[a], "after", of[b]] += 1
    assert {(a, b): table[a, b] for a, b in zip(*np.nonzero(table))} == want
    got = Counter()
    for r in near.collect():
        for code, n in np.frombuffer(r.near, np.uint32).reshape(-1, 2).tolist():
            for side, c in (("before", code // (width + 1)), ("after", code % (width + 1))):
                if c < width:
                    got[r.word, side, c] += n
    assert got == want_near


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    follow = np.zeros((20, 20))
    for _ in range(20000):  # words of one half are followed by words of the other
        a = rng.integers(20)
        follow[a, rng.integers(10) + (10 if a < 10 else 0)] += 1
    own = brown.exchange(follow, 20, 2)
    assert len(set(own[:10])) == 1 and len(set(own[10:])) == 1 and own[0] != own[19]


def test_language_id(spark):
    rng = random.Random(6)
    letters = {"xx": "abcdeé", "yy": "fghijß", "zz": "klmnoа"}
    make = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, make(lang, rng.randint(3, 80)), lang) for i, lang in enumerate(list(letters) * 60)]
    df = spark.createDataFrame([(i, t, lang, "s", 0.5) for i, t, lang in rows] + [(900, None, "xx", "s", 0.5), (901, "12 %% 34", "xx", "s", 0.5), (902, "", None, "s", 0.5), (903, "qqqq wwww vvvv " * 30, None, "s", 0.5)], "doc_id int, text string, lang string, source string, score double")
    held = langid.fold(F.col("doc_id"), 3) == 1
    got = {r.doc_id: r for r in langid.identify_language(df, df.where(~held)).collect()}
    tested = [(got[i].lang_pred, lang) for i, _, lang in rows if fold(i, 3) == 1]
    assert np.mean([a == b for a, b in tested]) >= 0.99
    assert not any(got[i].rejected for i, _, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(got[i].rejected for i in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify_language(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify_language(df.limit(0), df).count() == 0


def test_language_sample_counts_copies_once(spark):
    # Most rows of one language are copies of one text, those of another of a few texts.
    rows = [("aa", "hot text")] * 3000 + [("aa", f"text {i}") for i in range(200)] + [("bb", f"copy {i % 20}") for i in range(4000)] + [("cc", None), (None, "x")]
    got = langid.language_sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", 50, 10**6)
    assert {lang: (len(t), len(set(t))) for lang, t in got.items()} == {"aa": (50, 50), "bb": (20, 20)}


def nearest_by_hand(rows, k=5):
    """(query id, vec id, cosine) in order for every query row; a row's own place is left out."""
    from fractions import Fraction as Q

    fine = [(n, i, [Q(x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and all(np.isfinite(v)) and any(v)]
    norm = {n: sum(x * x for x in v) for n, _, v in fine}
    out = []
    for n, i, v in fine:
        if i % 50 == 0:
            score = lambda m, w: (lambda d: (1 if d > 0 else -1) * float(d * d / (norm[n] * norm[m])) ** 0.5)(sum(x * y for x, y in zip(v, w)))
            other = sorted((-round(score(m, w), 12), j) for m, j, w in fine if m != n and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(other, 1)]
    return sorted(out)


def kneser_ney_by_hand(texts, order):
    """p(character | those before it in its word) from nested dictionaries, interpolated over all orders."""
    counts = [{} for _ in range(order)]
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f" {w} "
            for end in range(1, len(padded)):
                for m in range(min(order, end + 1)):
                    g = padded[end - m : end + 1]
                    counts[m][g] = counts[m].get(g, 0) + 1
    used = []
    for m in range(order):
        table = {}
        for g, n in counts[m].items():
            kinds = len({h[0] for h in counts[m + 1] if h[1:] == g}) if m < order - 1 else n
            table[g] = n if m == order - 1 or m > 0 and g[0] == " " else kinds or n
        used.append(table)

    def p(gram):
        m = len(gram) - 1
        table, context = used[m], gram[:-1]
        mine = [n for g, n in table.items() if g[:-1] == context]
        lower = p(gram[1:]) if m else None
        if not m:
            lower = langid.UNSEEN + (1 - langid.UNSEEN) / (len(used[0]) + 1)
            if gram not in table:
                return discount(0) * len(mine) / sum(mine) * langid.UNSEEN
        if not mine:
            return lower
        d = discount(m)
        return max(table.get(gram, 0) - d, 0) / sum(mine) + d * len(mine) / sum(mine) * lower

    def discount(m):
        one, two = (sum(n == k for n in used[m].values()) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5

    return p


def test_kneser_ney_against_dictionaries():
    rng = random.Random(14)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    samples = {"xx": [make("abcde", 40) for _ in range(4)], "yy": [make("cdefg", 40) for _ in range(4)]}
    model = langid.train(samples, order=3)
    texts = [make("abcdefg", 30), "Abc, bad-dab 12 gfe", "", None, "zzz", "a"]
    total, _, n = langid.score_texts(texts, model)
    for k, lang in enumerate(model.languages):
        p = kneser_ney_by_hand(samples[lang], 3)
        for i, t in enumerate(texts):
            grams = [f" {w} "[max(0, e - 2) : e + 1] for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for e in range(1, len(w) + 2)]
            assert n[i] == len(grams)
            assert total[i, k] == pytest.approx(sum(math.log(p(g)) for g in grams), rel=1e-4), (lang, t)


def test_long_texts_are_scored_by_pieces():
    rng = random.Random(15)
    samples = {"xx": ["".join(rng.choice("abcde ") for _ in range(400)) for _ in range(6)]}
    model = langid.train(samples)
    long = "".join(rng.choice("abcde, ") for _ in range(50_000))
    whole, small = langid.score_texts([long, "ab", None], model), langid.score_texts([long, "ab", None], model, size=700)
    for a, b in zip(whole, small):
        assert np.allclose(a, b)
    assert langid.score_texts(["ab" * 100_000], model, size=1000)[2][0] >= 200_001


@pytest.mark.parametrize(("shard", "size"), [(10_000, 16_000_000), (60, 200)])
def test_nearest_neighbours(spark, shard, size):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8))
    v[100:140] = v[100]
    rows = [(int(i), [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2101, [None] * 8), (2150, [1.0, 2.0]), (2151, [2.0, 4.0]), (None, [1.0] * 8), (2200, [])]
    rows += [(50, rows[7][1]), (50, rows[9][1]), (200, rows[200][1])]  # ids that occur twice
    for i, r in enumerate(rows[:30]):
        rows.append((3000 + i, [x * 10.0 ** (20 * i - 290) for x in r[1][:6]]))  # finite, yet their squares are not
    rows += [(4000, [1e200, -1e200, 1e-200]), (4050, [1e-200, 1e-200, 1e-210]), (4051, [5e-324, 0.0, 0.0]), (4052, [1.7e308, 1e308, 1e308])]
    df = spark.createDataFrame([(*r, "x", 9, 1) for r in rows], "vec_id bigint, embedding array<double>, id string, rank int, place int")
    got = vptree.nearest_neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=shard, query_bytes=size).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in got) == nearest_by_hand(rows)
    assert vptree.nearest_neighbours(df.limit(0), df).count() == 0
    assert vptree.nearest_neighbours(df, df.limit(0)).count() == 0


def test_relaxed_pruning_keeps_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 16)) * 0.2
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    ask = df.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest_neighbours(df, ask).collect()}
    near = {(r.query_id, r.vec_id) for r in vptree.nearest_neighbours(df, ask, factor=0.7).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_jaccard_links_rows_without_an_id(spark):
    rng, vocab = random.Random(21), vocabulary(21)
    base = text(rng, vocab, 60).split()
    near = " ".join([*base[:59], "other"])
    far = text(rng, vocab, 60)
    rows = [(1, " ".join(base)), (None, near), (None, far), (None, far.upper()), (None, far + " more"), (None, None), (2, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(docs(spark, rows)).collect()), key=str)
    n = lambda t: len({tuple(w) for w in zip(*(t.lower().split()[k:] for k in range(5)))})
    assert got == sorted([(1, n(" ".join(base)), 1), (None, n(near), 1), (None, n(far), None), (None, n(far), None), (None, n(far + " more"), None), (None, 0, None), (2, 0, 2)], key=str)
    roots = {r.root for r in jaccard.ngram_jaccard_join(docs(spark, rows[2:5])).collect()}
    assert len(roots) == 1


@pytest.mark.parametrize("compiled", [50, 0])
def test_rule_ties_whatever_their_number(spark, monkeypatch, compiled):
    monkeypatch.setattr(urls, "COMPILED_RULES", compiled)
    pages = spark.createDataFrame([(1, "http://a.com/x", ""), (2, "http://b.a.com/xy", ""), (3, "http://c.org/p", "")], "page_id int, url string, html string")
    tied = [("block", "a.com", "/"), ("allow", "a.com", "/"), ("block", "b.a.com", "/"), ("allow", "a.com", "/xy"), ("block", "c.org", "/p"), ("block", "org", "/")]
    for rules in (tied, tied[::-1], tied + [("block", f"x{i}.net", "/") for i in range(60)]):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(pages, rules).collect()}
        assert got == {1: ("a.com/", "allow"), 2: ("a.com/xy", "allow"), 3: ("c.org/p", "block")}


STORY = "".join(f"<p>Long paragraph number {i} of the main story with many words in it.</p>" for i in range(12))


@pytest.mark.parametrize("weights", [html_text.Weights(), html_text.Weights(0.5, {"comments": -4.0, "promo": -4.0})])
@pytest.mark.parametrize("page,least,without", [
    ("<article><p>We walked to the <a href='/hidden-valley'>X</a> and on.</p></article>", 26, "@"),
    ("<article><p title='A hidden gem' id>Words of a gem here now.</p></article>", 24, "@"),
    ("<article><div data-hidden='false'>Kept words stay here now.</div></article>", 25, "@"),
    ("<article><p data-id='ad-cookie' \"role='menu' x>Kept words stay here now too.</p></article>", 0, "@"),
    (f"<body><nav><a href=x>menu</a></nav><div class='comments'>{STORY}</div><footer>foot words</footer></body>", 700, "foot"),
    (f"<body><div class='promo'>{STORY}</div></body>", 700, "@"),
    (f"<body><div class='comments'><article>{STORY}</article></div></body>", 700, "@"),
    (f"<body><article>{STORY}</article><div class='comments'><p>reader {STORY}</p></div></body>", 700, "reader"),
    (f"<body><div class=story>{STORY}</div><div class='comments'><p>reader short</p></div></body>", 700, "reader"),
    ("<article><p hidden>no</p><p aria-hidden='true'>no</p><p style='display:none'>no</p><p>yes it is here</p></article>", 14, "no"),
])
def test_attributes_and_names_of_elements(page, least, without, weights):
    got = html_text.main_text(page, weights)
    assert len(got) >= least and without not in got


def test_uncompressed_archives_in_several_splits(spark, tmp_path):
    """Records whose payloads hold record starts, in files that Spark reads in pieces of 4,000 bytes."""
    rng = random.Random(9)
    want = []
    for name in ("a.warc", "b.warc", "c.warc.gz"):
        data = b""
        for i in range(70):
            body = b"".join(rng.choice([b"x" * rng.randint(1, 90), b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", b"\r\n\r\n", b"WARC/1."]) for _ in range(rng.randint(0, 6)))
            want.append((f"<urn:{name}:{i}>", body))
            data += f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{name}:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    try:
        got = [(r.record_id, bytes(r.payload), r.cut) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(got) == sorted((i, b, False) for i, b in want)
