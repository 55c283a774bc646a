"""Exact duplicates against a brute-force grouping."""

import hashlib
import re

from pyspark.sql import functions as F

from polysafe.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, _digest int, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "en") for i, t in rows], SCHEMA)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [(5, "a b"), (3, "a \t\n b"), (9, "a  b"), (1, ""), (2, None), (4, " "), (7, "c"), (7, "c"), (8, "d" * 50_000), (10, "d" * 50_000),
        (None, "c"), (None, "solo"), (11, "A b"), (12, "a b "), (13, "é\x0bé"), (14, "é é"), (15, "\u00a0")]


def test_matches_brute_force(spark):
    got = exact.duplicate_groups(frame(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got), key=repr) == brute(ROWS)


def test_contents_decide_where_digests_clash(spark):
    rows = [(k, f"text {k % 7}") for k in range(40)]
    got = exact.duplicate_groups(frame(spark, rows), digest=lambda c: F.length(c).cast("string").cast("binary"), salts=3).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(k, k % 7, len(range(k % 7, 40, 7))) for k in range(40)]


def test_hot_group_is_salted(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('u', id), 'hot') AS text")
    got = exact.duplicate_groups(rows)
    assert got.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.max("group_size")).first()[:] == (13_333, 1, 1, 13_333)


def test_dedup_keeps_all_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 1, 4, 7, 8, 11, 12, 13, 15, None}


def test_empty_table(spark):
    docs = frame(spark, [])
    assert exact.duplicate_groups(docs).collect() == [] and exact.exact_dedup(docs).collect() == []


def test_no_python_in_the_plan(spark):
    plan = exact.duplicate_groups(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rows = [(0, "A b"), (1, "A  b"), (1, "B c"), (1, "B c"), (None, "A b"), (None, "own"), (None, "B\tc")]
    kept = sorted(((r.doc_id, r.text) for r in exact.exact_dedup(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(0, "A b"), (1, "B c"), (1, "B c"), (None, "own")], key=repr)
