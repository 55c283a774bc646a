"""Readers for the file layouts the study uses: CSV/TSV tables, JSON prompt
files, taxonomy and language lists, nested score files, run directories.

Every reader is one distributed scan with an explicit schema where the
layout allows it (no inference pass), and file-level attributes come from the
``_metadata`` column instead of directory walks on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polysafe.dims import SPLIT_OVERRIDES

SCORE_JSON_TYPE = "map<string,map<string,double>>"


def _by_layout(spark: SparkSession, path: str, options: dict, read) -> DataFrame:
    """``read(files)`` once for each distinct header line, united by column name.

    One scan of CSV files takes the first file's header for all of them;
    files of another layout would be read by position.  The number of
    layouts is small whatever the number of files.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value",
        F.col("_metadata.file_block_start").alias("block"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("head"))
    layouts = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    out = None
    for row in layouts:
        df = read(row.files)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else read([path])


def _without_index(df: DataFrame) -> DataFrame:
    """Without the index column that pandas writes (an empty or ``Unnamed: 0`` header)."""
    return df.drop(*[c for c in df.columns if c == "_c0" or c.startswith("Unnamed: ")])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with quoted multi-line text (pandas-style quoting: ``""`` escapes ``"``).

    The index column that pandas writes is dropped.  Columns are matched *by
    name*, in every file by its own header; with a schema they are also cast
    (no inference pass), and a column that a file lacks is null.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"') \
        .option("escape", '"').option("sep", sep).option("mode", "PERMISSIVE")

    def read(files: list[str]) -> DataFrame:
        if schema is None:
            return _without_index(r.option("inferSchema", True).csv(files))
        fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
        raw = r.csv(files)
        return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in fields])

    return _by_layout(spark, path, {}, read)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_prompt_files(spark: SparkSession, path: str, type_col: str = "type") -> DataFrame:
    """JSON array files, one per prompt type; the file name (without ``.json``) becomes a column."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumn(type_col, F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One text column per line: first comma field = language, last = resource class."""
    parts = F.split(F.col("value"), ",")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.trim(F.element_at(parts, 1)).alias("language"), F.trim(F.element_at(parts, -1)).alias("cat"))


def read_line_list(spark: SparkSession, path: str, col: str = "language") -> DataFrame:
    """One entry per line, newline and surrounding blanks removed, empty lines skipped."""
    return spark.read.text(path).select(F.trim(F.col("value")).alias(col)).where(F.length(col) > 0)


def read_nested_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score JSON files ``{language: {response_language: pct}}`` -> long rows.

    Each file is one record (``wholetext``); its path is kept so that run
    attributes (model, metric, checkpoint) can be parsed from it.
    """
    raw = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.from_json(F.col("value"), SCORE_JSON_TYPE).alias("m"))
    outer = raw.select("file_path", F.explode("m").alias("language", "inner"))
    return outer.select("file_path", "language", F.explode("inner").alias("language_response", "pct"))


def discover_runs(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Scan every run file under ``root/<composition>/<checkpoint file>`` in one job.

    Keeps model and checkpoint as columns, skips JSON files and checkpoint 0.
    """
    found = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    path = F.col("_metadata.file_path")

    def read(files: list[str]) -> DataFrame:
        df = (r.options(**found) if files == [root] else r).csv(files)
        return _without_index(df.withColumn("model", F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)).withColumn(
            "checkpoint", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "-"), -1), r"\.csv$", "")))

    return _by_layout(spark, root, found, read).where(F.col("checkpoint") != "0")


def read_split(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """Corpus split stored as Parquet under ``root/dataset/split`` (with the split
    name overrides of ``dims.SPLIT_OVERRIDES``)."""
    split = SPLIT_OVERRIDES.get(dataset.rsplit("/", 1)[-1], {}).get(split, split)
    return spark.read.parquet(f"{root}/{dataset}/{split}")


def read_prompt_partition(spark: SparkSession, root: str, prompts_type: str, split: str, harmtype: str,
                          language: str) -> DataFrame:
    """Prompt table partitioned by ``prompts_type/split/harmtype/language``; the
    predicate on partition columns prunes directories at planning time."""
    df = spark.read.parquet(root)
    return df.where((F.col("prompts_type") == prompts_type) & (F.col("split") == split)
                    & (F.col("harmtype") == harmtype) & (F.col("language") == language))
