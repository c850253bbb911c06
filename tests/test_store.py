"""Bucketed tables: which buckets a change touches, crashes and second writers."""

import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import jobs
from tidewell.sources import store

SCHEMA = T.StructType().add("k", T.LongType()).add("part", T.StringType()).add("v", T.DoubleType())
TABLE = {"t": (SCHEMA, ["k", "part"])}


def make(spark, tmp_path, n=60, buckets=8):
    tables = store.TableStore(spark, f"file://{tmp_path}/db", TABLE, buckets)
    tables.upsert("t", frame(spark, [(i, "ab"[i % 2], float(i)) for i in range(n)]))
    return tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, part string, v double")


def held(tables):
    return sorted(tuple(r) for r in tables.read("t").collect())


def test_one_key_touches_one_bucket(spark, tmp_path):
    tables = make(spark, tmp_path)
    before, rows = tables.manifest("t"), dict(((k, p), v) for k, p, v in held(tables))
    assert len(before.files) == 8 and len(rows) == 60
    row = frame(spark, [(7, "b", 99.0)])
    bucket = tables._bucketed("t", row, 8).first()["_bucket"]
    aside = {b: f"{tmp_path}/aside{b}" for b in before.files if b != bucket}
    for b, place in aside.items():  # a write that reads another bucket fails
        shutil.move(f"{tmp_path}/db/t/{before.files[b][0]}", place)
    assert tables.upsert("t", row) == 1
    for b, place in aside.items():
        shutil.move(place, f"{tmp_path}/db/t/{before.files[b][0]}")
    after = tables.manifest("t")
    assert {b for b in after.files if after.files[b] != before.files[b]} == {bucket}
    assert held(tables) == sorted((*k, v) for k, v in {**rows, (7, "b"): 99.0}.items())


def test_random_changes_equal_a_dict(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    tables, rng, want = make(spark, tmp_path, 0, 3), random.Random(5), {}
    assert held(tables) == []
    for step in range(6):
        rows = [(rng.randint(0, 25), rng.choice(["a", None]), rng.random()) for _ in range(12)]
        if step % 2:
            fresh = {}
            for k, p, v in rows:
                fresh.setdefault((k, p), v)
            new = {key: v for key, v in fresh.items() if key not in want and key[1] is not None}
            one_of = [(k, p, v) for (k, p), v in fresh.items() if p is not None]
            assert tables.insert_ignore("t", frame(spark, one_of or rows[:0])) == len(new)
            want |= new
        else:
            assert tables.upsert("t", frame(spark, rows).coalesce(1)) == 12
            want |= {(k, p): v for k, p, v in rows}
        assert {(k, p): v for k, p, v in map(tuple, tables.read("t").collect())} == want
    assert all(len(parts) <= 2 for parts in tables.manifest("t").files.values())
    tables.rebucket("t", 5)
    assert tables.manifest("t").buckets == 5 and {(k, p): v for k, p, v in map(tuple, tables.read("t").collect())} == want


def test_inserting_nothing_new_writes_nothing(spark, tmp_path):
    tables = make(spark, tmp_path)
    before = tables.manifest("t")
    assert tables.insert_ignore("t", tables.read("t")) == 0 and tables.upsert("t", tables.read("t").limit(0)) == 0
    assert tables.manifest("t") == before


def test_crash_leaves_the_table_and_vacuum_clears(spark, tmp_path, monkeypatch):
    tables = make(spark, tmp_path)
    before = held(tables)

    def crash(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(store.TableStore, "_commit", crash)
        with pytest.raises(RuntimeError, match="power cut"):
            tables.upsert("t", frame(spark, [(1, "b", -1.0)]))
    assert held(tables) == before and tables.manifest("t").version == 1
    bad = frame(spark, [(1, "b", -1.0)]).withColumn("v", F.raise_error(F.lit("bad row")).cast("double"))
    with pytest.raises(Exception, match="bad row"):
        tables.upsert("t", bad)
    assert held(tables) == before
    assert tables.vacuum("t") >= 1 and tables.vacuum("t") == 0 and held(tables) == before


def test_second_writer_fails(spark, tmp_path):
    tables = make(spark, tmp_path)
    stale = tables.manifest("t")
    tables.upsert("t", frame(spark, [(1, "b", 5.0)]))
    with pytest.raises(Exception, match="(?i)exist"):
        tables._commit("t", store.Manifest(stale.version + 1, stale.buckets, {}))
    assert (1, "b", 5.0) in held(tables)


def test_old_folders_go_and_update_keeps_keys(spark, tmp_path):
    tables = make(spark, tmp_path)
    first = tables.manifest("t").folders()
    for k in range(4):
        tables.update("t", frame(spark, [(0, "a", 0.0)]), lambda t, k=k: t.withColumn("v", F.when((F.col("k") == 0), float(k)).otherwise(F.col("v"))))
    assert (0, "a", 3.0) in held(tables) and len(held(tables)) == 60
    assert len(list((tmp_path / "db/t").glob("_manifest.*"))) == 2
    gone = first - tables.manifest("t").folders()
    assert len(gone) == 1 and not (tmp_path / "db/t" / gone.pop()).exists()


def test_table_counts(spark):
    assert jobs.table_counts({"a": spark.range(3).toDF("x"), "b": spark.range(0).toDF("y")}) == {"a": 3, "b": 0}
