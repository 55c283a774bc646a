"""Incremental evaluation with Structured Streaming.

New model-output files (one per run/checkpoint) are picked up as they land;
the stateless part (clean-up, response language, refusal class) is the very
same Column code / Arrow functions as the batch jobs, and the per-cell class
counts are kept as streaming aggregation state.  The state is bounded by the
dimensions (runs x languages x response languages), so it never grows with
the data.  The file source's checkpoint replaces the "skip outputs already
evaluated" logic of the study: processed files are never read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from polysafe.dims import LanguageDim
from polysafe.operators import metrics, scoring


def read_outputs_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                        max_files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger).load(path)


def score_stream(outputs: DataFrame, detector=scoring.reference_detector,
                 language_id=scoring.stopword_language_id) -> DataFrame:
    """Clean outputs, identify response language and classify refusals (stateless)."""
    cleaned = scoring.clean_outputs(outputs)
    with_lang = scoring.detect_language(cleaned, language_id)
    return scoring.classify_refusal(with_lang, detector)


def cell_count_stream(scored: DataFrame, dim: LanguageDim, run_keys: Sequence[str] = ("model", "prompt_type")) -> DataFrame:
    """Streaming per-cell counts: the first aggregation level of the batch metric,
    kept as state; ``metrics.densify_cells`` turns the table into the dense matrix."""
    return metrics.partial_cell_counts(metrics.with_prompt_type(scored), dim, run_keys)


def start_cell_counts(counts: DataFrame, table_path: str, checkpoint_location: str,
                      available_now: bool = True) -> StreamingQuery:
    """Keep the current cell counts as a Parquet table (complete output of a bounded state)."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_location) \
        .foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
