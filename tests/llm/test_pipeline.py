"""The pipeline's stages against brute force on the small test tables."""

import os
import random

import pytest
from brute import components, leaks, repeats, shingles, words
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm.scratch import BATCH_BYTES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = str(tmp_path / name)
        stages[name](spark, df, SMALL).write.parquet(out)
        return spark.read.parquet(out)

    docs = step("language_id", docs)
    assert docs.columns == columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) >= 0.98 * len(before)
    docs = step("near_duplicates", docs)
    want = {i for i, (_, c) in components(kept).items() if c == i}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == want and docs.columns == columns
    gone = repeats(list(kept.items()))
    docs = step("repeated_passages", docs)
    assert docs.columns == columns
    after = {r.doc_id: r for r in docs.collect()}
    for i, t in kept.items():
        left = len(words(t)) - gone.get(i, (0, 0))[1]
        assert len(words(after[i].text)) == left if i in after else left == 0
        assert i not in after or after[i].n_chars == len(after[i].text)
    docs_before = {i: r.text for i, r in after.items()}
    docs = step("decontamination", docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {r.doc_id for r in docs.collect()} == {i for i, (_, hit, _) in leaks(docs_before, items).items() if not hit}
    mixed = step("mixing", docs).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in docs.collect()}
    assert all(r.taken <= 3 * r.size for r in mixed)


CLASHING = "items,hit_words,n_words,rest,text_hash,root,node,id,t,i,_spans,spans,cut,rejected,score,lang_pred,entropy,size,target,taken,k,part,a b,a.b,x:y,q`t,_,none,c0,n_lines".split(",")


def odd_table(spark):
    """Ids with two texts, equal rows, nulls in every column, wordless texts, a very long one, and clashing names."""
    rng = random.Random(3)
    w = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    x, y, z = w(80), w(70), w(60)
    near = x.split()
    near[40] = "other"
    rows = [(1, x), (2, x), (2, y), (3, " ".join(near)), (None, x), (5, z), (5, z), (5, z), (6, None), (6, None), (7, ""), (8, "12 34"), (None, w(50)), (9, w(4)), (9, w(5)), (11, w(40) + " " + y), (12, w(30000))]
    rows += [(100 + i, w(60)) for i in range(40)]
    rows = [(i, t, None if k % 9 == 8 else "xx", [None, "a", "b", "c"][k % 4], len(t or "") if k % 5 else None) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = spark.createDataFrame([(1, z), (2, None), (None, w(12))], "item_id bigint, text string")
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING)), items, rows


def test_stages_on_odd_rows(spark, tmp_path):
    df, items, rows = odd_table(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert got.columns == docs.columns
            assert all(r[c] == c for r in got.collect() for c in CLASHING)
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    pairs = lambda got: sorted(((r.doc_id, r.text) for r in got.collect()), key=key)

    def kept(name):
        return pairs(stages[name](spark, docs, str(tmp_path)))

    own = sorted(((r[0], r[1]) for r in rows), key=key)
    assert kept("language_id") == [r for r in own if r[1] and any(c.isalpha() for c in r[1])]
    # One of each group of near-equal texts stays: the smallest id with a text, null last; wordless texts all stay.
    distinct, groups = {r for r in own if words(r[1])}, []
    for r in sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0)):
        a = shingles(r[1])
        for g in groups:
            if any(100 * len(a & shingles(o[1])) >= 75 * len(a | shingles(o[1])) for o in g):
                g.append(r)
                break
        else:
            groups.append([r])
    want = [g[0] for g in groups] + [r for r in own if not words(r[1])]
    assert kept("near_duplicates") == sorted(want, key=key)
    assert (2, rows[2][1]) in want and (2, rows[1][1]) not in want
    clean = leaks({k: r[1] for k, r in enumerate(own)}, [(r.item_id, r.text) for r in items.collect()])
    assert kept("decontamination") == [r for k, r in enumerate(own) if not clean[k][1]]
    once = {r: None for r in own}
    gone = repeats_by_row(list(once))
    left = {(i, t): len(words(t)) - gone.get((i, t), 0) for i, t in own}
    cut = stages["repeated_passages"](spark, docs, str(tmp_path)).collect()
    assert sorted(len(words(r.text)) for r in cut) == sorted(left[r] for r in own if left[r] or not words(r[1]))
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut)
    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    assert sorted(r["size"] for r in mixed) == sorted(len(words(r[1])) for r in own)


def repeats_by_row(rows, least=50):
    """Words cut from each (id, text), which are distinct, in order of id (null first), Spark's text hash and position."""
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, cut = words(r[1]), set()
        for p in range(len(w) - least + 1):
            if first.setdefault(tuple(w[p : p + least]), (r, p)) != (r, p):
                cut |= set(range(p, p + least))
        out[r] = len(cut)
    return out


def test_run_is_its_stages(spark, tmp_path):
    df, items, _ = odd_table(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "repeated_passages", "decontamination"])
def test_stages_send_texts_to_python_in_small_batches(spark, tmp_path, name):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.concat(F.col("id"), F.lit(" ")), 2000).alias("text"))
    docs = spark.createDataFrame([(1, "one two three", "web", "en", 13)], "doc_id long, text string, source string, lang string, n_chars long")
    spark.createDataFrame([(1, "four five")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        sent = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in sent) == 2000
        assert max(r["size"] for r in sent) < 1.1 * BATCH_BYTES
        spark.conf.set(key, "123456")
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key)
