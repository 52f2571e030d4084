"""Result tables: append, resume, merge of small files, named values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exselect.functions.labels import clean_label
from exselect.session import cut_lineage

# Record schemas of the result trees; every reader declares them.
SCORING_SCHEMA = (
    "explanation_type string, model string, estimator string, document_idx bigint, train_dataset string, "
    "train_split string, test_dataset string, test_split string, linear_coder string, pred_gain double, "
    "mse double, l1 double, l2 double, t array<double>"
)
VALIDATION_SCHEMA = (
    "explanation_type string, model string, estimator string, document_idx bigint, train_dataset string, "
    "train_split string, test_dataset string, test_split string, indices_trained_on array<bigint>, "
    "indices_target_document bigint, delta_log_p double, log_p_before double, log_p_after double, "
    "jsd double, `kld(before||after)` double"
)


def append_records(records: DataFrame, path: str, partition_by: list[str]) -> None:
    records.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_selections(selections: DataFrame, path: str) -> None:
    """One folder per method, k and lambda, so a setting is found again by partition pruning."""
    append_records(selections, path, ["method", "k", "lambda"])


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid rows without a stored result; null-safe, since settings leave unused parameters null."""
    match = None
    seen = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"_{key}"))
        match = same if match is None else match & same
    return grid.join(seen, match, "left_anti")


LEDGER_SCHEMA = "path string, outcome string, detail string, rows bigint, batch bigint"
PROBED_BYTES = 1 << 30  # a longer file is no small one: it is not taken into memory, and a failure to read it is no damage


def probe(spark: SparkSession, paths: list[str], batch: int = 0) -> DataFrame:
    """One row of LEDGER_SCHEMA per file: outcome `whole` or `damaged`, what the decoder said, and its number of rows.

    Spark reads the bytes in the tasks, so whatever keeps it from them (a lost executor, a full disk, no access, a store
    that is away) fails the job. Only bytes that have arrived and cannot be decoded to their end make a file damaged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for path, content in zip(found["path"].to_pylist(), found["content"]):
                yield pa.RecordBatch.from_pylist([{"path": path, **decoded(content.as_buffer()), "batch": batch}], schema=kinds)

    kinds = pa.schema([("path", pa.string()), ("outcome", pa.string()), ("detail", pa.string()), ("rows", pa.int64()), ("batch", pa.int64())])
    if not paths:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    files = spark.read.format("binaryFile").load(paths)
    short = files.where(F.col("length") <= PROBED_BYTES).select("path", "content").mapInArrow(run, LEDGER_SCHEMA)
    long = files.where(F.col("length") > PROBED_BYTES).select(
        "path", F.lit("whole").alias("outcome"), F.lit("not probed").alias("detail"), F.lit(None).cast("bigint").alias("rows"),
        F.lit(batch).cast("bigint").alias("batch"))
    return short.unionByName(long)


def decoded(content: pa.Buffer) -> dict:
    """Decode a Parquet file that is in memory, one batch of rows at a time. Other errors than the decoder's are raised."""
    rows = 0
    try:
        for found in pq.ParquetFile(pa.BufferReader(content)).iter_batches(4096):
            rows += found.num_rows
    except (pa.ArrowException, OSError) as error:
        if isinstance(error, MemoryError) or getattr(error, "errno", None):  # the machine's, not the decoder's
            raise
        return {"outcome": "damaged", "detail": f"{type(error).__name__}: {error}"[:500], "rows": rows}
    return {"outcome": "whole", "detail": None, "rows": rows}


def whole_files(
    spark: SparkSession, paths: list[str], schema: str | StructType, base: str, batch: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be decoded to their end, and the ledger of all of them.

    Values in folder names below `base` (`key=value`) are columns. The ledger is worked out once and kept.
    """
    ledger = cut_lineage(probe(spark, paths, batch))
    good = sorted(r.path for r in ledger.where("outcome = 'whole'").select("path").collect())  # as many paths as came in
    if not good:
        return spark.createDataFrame([], schema), ledger
    return spark.read.schema(schema).option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).option("basePath", base).parquet(*good), ledger


def merge_small_files(
    spark: SparkSession, source: str, target: str, schema: str | StructType, files: int | None = None,
    file_bytes: int = 256 << 20, ledger: str | None = None,
) -> DataFrame:
    """Rewrite a tree of small Parquet files as files of about `file_bytes`; returns the paths of damaged ones.

    A file that breaks off anywhere is left out whole and listed; any other failure is raised, and nothing is listed. `ledger`
    names a table that gets a row per file. Values in folder names (`key=value`) are columns, as in the tree that
    `append_records` writes. The list of paths is on the driver, as it is in any Spark scan.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(source).select("path", "length").collect()
    )
    if files is None:
        files = max(1, -(-sum(r.length for r in listed) // file_bytes))
    rows, judged = whole_files(spark, [r.path for r in listed], schema, source)
    rows.repartition(files).write.mode("overwrite").parquet(target)
    if ledger:
        judged.write.mode("overwrite").parquet(ledger)
    return judged.where("outcome = 'damaged'").select("path")


def upsert_values(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Latest value per label; labels lose their digits and match as a whole."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    both = both.withColumn("label", clean_label("label"))
    last = Window.partitionBy("label").orderBy(F.desc("_turn"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("label", "value")


def as_commands(values: DataFrame) -> DataFrame:
    r"""One text line \newcommand{\label}{value} per stored value."""
    return values.select(
        F.concat(F.lit("\\newcommand{\\"), "label", F.lit("}{"), F.col("value").cast("string"), F.lit("}")).alias("value")
    )
