"""Rendezvous shards against hashlib, their law, their slots and their edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polysafe.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot int"


def brute(key, weights, seed=sharding.SEED):
    said = "" if key is None else str(key)

    def u(s):
        return (int(hashlib.md5(f"shard {s}:{seed}:{said}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    return max((w / -math.log(u(s)), s) for s, w in enumerate(weights))[1]


def mixed(key):
    return int(hashlib.md5(f"slot:{sharding.SEED}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


ROWS = [(k, f"text {k % 11} é" * (k % 5)) for k in range(400)] + [(None, None), (None, "x"), (7, "x"), (7, "x"), (7, ""), (9, "w " * 50_000)]


def test_rows_against_brute_force(spark):
    got = sharding.place(spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], SCHEMA)).collect()
    want, at = [], Counter()
    raw = [(i, t or "") for i, t in ROWS]
    for i, t in sorted(raw, key=lambda r: (mixed(r[0]), r[0] is not None, r[0], len(r[1].encode()), zlib.crc32(r[1].encode()))):
        s = brute(i, [1.0] * 8)
        want.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key", s, at[s], brute(i, [1.0] * 9)))
        at[s] += 1
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    got = sharding.place(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and abs(len(moved) / len(got) - 1 / 9) < 0.01
    assert all(abs(n / len(got) - 1 / 8) < 0.01 for n in Counter(r.shard for r in got).values())


def test_weights_and_a_heavier_shard(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    old = {r.doc_id: r.shard for r in sharding.assign(ids, [1, 2, 3]).collect()}
    new = {r.doc_id: r.shard for r in sharding.assign(ids, [1, 2, 5]).collect()}
    share = Counter(old.values())
    assert all(abs(share[s] / 20_000 - (s + 1) / 6) < 0.015 for s in range(3))
    assert {new[i] for i in old if old[i] != new[i]} == {2}
    for bad in ([], [1, 0], [1, -1], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.bids(F.col("doc_id"), bad)


def test_hot_id_and_hot_row(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, -1, id) AS doc_id", "if(id % 6 = 0, 'same', concat('t', id)) AS text")
    got = sharding.place(rows)
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    assert sum(r.n for r in per) == 9000 and all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in per)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)] + [(7, "t7")] * 3, "doc_id long, text string")
    sharding.write_shards(docs, f"{tmp_path}/out", files=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.shard) for r in back.collect()) == sorted((r.doc_id, r.text, brute(r.doc_id, [1.0] * 8)) for r in docs.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.place(docs).collect() == [] and sharding.assign(docs).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = sharding.place(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
