"""Incremental merge of result files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from exselect.sources.results import pending, whole_files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def merge_arrivals(
    spark: SparkSession, source: str, target: str, state: str, schema: str, keys: list[str],
    damaged: str | None = None, files_per_batch: int = 10_000, ledger: str | None = None,
) -> StreamingQuery:
    """Append new records of a folder tree to `target`, one per key, and stop when nothing is left.

    `state` is the query's checkpoint folder: it remembers the files already merged. A key already in `target` is
    left out by a join with the target, so no state grows with the results, and a batch that is run again after a
    failure adds only what is missing. A null key is a value like any other. Values in folder names (`key=value`) are
    columns. A file that breaks off anywhere is left out whole and listed in the table `damaged` (by default next to the
    target). Whatever else goes wrong, a lost task, a full disk or a store that is away, fails the batch, which is not
    committed and runs again. The table `ledger` (by default next to the target) holds for each file what became of it and in
    which batch; both tables keep a folder per batch that a repeated batch writes anew. A batch holds the
    paths of at most `files_per_batch` files on the driver.
    """
    damaged = damaged or target.rstrip("/") + "_damaged"
    ledger = ledger or target.rstrip("/") + "_ledger"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(target)
    arrived = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).load(source).select("path")
    )

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows, judged = whole_files(session, [r.path for r in batch.collect()], schema, source, number)
        stored = session.read.schema(schema).parquet(target)
        pending(rows.dropDuplicates(keys), stored, keys).write.mode("append").parquet(target)
        bad = judged.where("outcome = 'damaged'")
        if not bad.isEmpty():
            bad.select("path").write.mode("overwrite").parquet(f"{damaged}/batch={number}")
        judged.drop("batch").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return (
        arrived.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
