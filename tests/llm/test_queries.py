"""The registered queries: all there, with the contracts' columns, equal to their SQL."""

import os

import pytest
from conftest import SF01, SF001
from oracle_compare import compare, duck

import __spark_entry__ as entry
from polysafe.llm.queries import ORACLE, QUERIES

FIRST = {
    1: ["doc_id", "held_out", "lang_pred", "score"],
    2: ["doc_id", "n_shingles", "component_id"],
    3: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    4: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    5: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    6: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    7: ["doc_id", "item_id"],
    8: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    9: ["page_id", "host", "path", "rule", "verdict"],
    10: ["doc_id"],
    11: ["doc_id", "n_features", "weight", "score", "rank"],
    12: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    13: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLE) <= set(entry.oracle_sql())
    for n in FIRST:
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.parametrize("n", sorted(FIRST))
def test_columns(spark, n):
    (fn,) = [f for k, f in QUERIES.items() if k.startswith(f"op{n}_")]
    assert fn(spark, SF001).columns[:len(FIRST[n])] == FIRST[n]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, name):
    sf_dir = SF01 if os.environ.get("LLM_SQL_LARGE") else SF001
    r = compare(spark, name, QUERIES[name], ORACLE[name], sf_dir, duck(sf_dir))
    assert r["cols_ok"] and r["rows_ok"] and r["values_ok"], r


def test_language_prediction_ignores_lang_and_source(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    other.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (sorted(map(tuple, QUERIES["op1_language_id"](spark, d).select("doc_id", "lang_pred").collect())) for d in (SF001, str(tmp_path)))
    assert a == b
