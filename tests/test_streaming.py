"""Incremental evaluation over a file stream equals the batch metric."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from polysafe.dims import FIXTURE_LANGUAGES
from polysafe.operators import metrics
from polysafe.plans.adapters import model_outputs
from polysafe.streaming import scoring_stream as ss


def test_stream_counts_equal_batch(spark, scratch):
    outs = model_outputs(spark, SF001).withColumn("model", F.lit("en")) \
        .select("prompt_id", "model", "language", "language_category", "label", "data_type", "output")
    src = os.path.join(scratch, "outputs")
    outs.where(F.col("prompt_id") % 2 == 0).write.parquet(src)
    schema = outs.schema
    stream = ss.read_outputs_stream(spark, src, schema)
    counts = ss.cell_count_stream(ss.score_stream(stream), FIXTURE_LANGUAGES)
    table, ckpt = os.path.join(scratch, "counts"), os.path.join(scratch, "ckpt")
    ss.start_cell_counts(counts, table, ckpt).awaitTermination()
    # a second file lands; the next run only reads the new file
    outs.where(F.col("prompt_id") % 2 == 1).write.mode("append").parquet(src)
    ss.start_cell_counts(counts, table, ckpt).awaitTermination()
    streamed = metrics.densify_cells(spark.read.parquet(table), FIXTURE_LANGUAGES)
    batch_scored = ss.score_stream(outs)
    batch = metrics.refusal_cell_counts(metrics.with_prompt_type(batch_scored), FIXTURE_LANGUAGES)
    key = ["model", "prompt_type", "language", "language_response"]
    a = sorted(tuple(r) for r in streamed.select(*key, *metrics.COUNT_COLS, "den_harmful").collect())
    b = sorted(tuple(r) for r in batch.select(*key, *metrics.COUNT_COLS, "den_harmful").collect())
    assert a == b and len(a) > 0
