"""Exact deduplication with streaming keyed state (operator 4). DataFrame functions only.

Arrivals (digest, stable identifier, content locator) run through a stateful streaming aggregation whose state lives
in RocksDB on disk and never expires: one entry per digest with the smallest identifier, the place of its text and the
number of rows seen. The state is read back as a table. A digest that was seen more than once is a hit; the full text
of every hit is compared with the text at the locator, and digests that hold several texts are split by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from exselect.llm.tables import shared_folder, stored, written
from exselect.session import small_side

#: State on disk; its changes are written to the checkpoint, and no files are allocated ahead of their content.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ROWS_PER_SALT = 512
PLACE_BYTES = 400  # a digest and a file name, at most


def normalised(text: str | Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def filed(docs: DataFrame) -> DataFrame:
    """The rows as a scan of Parquet files, which names the place of each row; other frames are written first."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, "dedup-rows")


def located(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def keyed_state(spark: SparkSession, path: str, bytes_per_batch: int) -> DataFrame:
    """Run stored arrivals through the stream; return (digest, keep, group_size), keep = (no_id, doc_id, _file, _row)."""
    checkpoint = shared_folder(spark, "dedup-state")
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        stream = (
            spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch)
            .parquet(path)
            .groupBy("digest")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")).alias("keep"),
                 F.count(F.lit(1)).alias("group_size"))
        )
        query = (stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        keep, size = (F.col(f"value.{name}") for name in state.schema["value"].dataType.names[:2])
        return stored(state.select(F.col("key.digest").alias("digest"), keep.alias("keep"), size.alias("group_size")), "dedup-groups")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def salted(size: Column) -> Column:
    """How many slices a group of this many rows is dealt into."""
    return F.ceil(size / ROWS_PER_SALT)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bytes_per_batch: int = 64 << 30,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and its place `_file`, `_row`.

    Texts are equal when they are identical after `normalised`; null counts as empty. In a group the smallest doc_id
    stays; null ids come last, and of repeated rows with the same id the one that comes first in the files stays, so
    exactly one row of a group is kept. An empty table gives an empty result. Other columns are not carried.
    `digest` may be weak: texts behind one digest are compared in full and split.
    """
    spark = docs.sparkSession
    source = located(filed(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    clean = normalised("text")
    path = written(source.select(digest(clean).alias("digest"), "doc_id", "_file", "_row"), "dedup-arrivals")
    state = keyed_state(spark, path, bytes_per_batch)
    grouped = spark.read.parquet(path).join(state, "digest")

    # Full bytes on hits: the text at the locator goes to its group, a large group in slices.
    hits = state.where("group_size > 1").select("digest", "keep", "group_size", salted(F.col("group_size")).alias("slices"))
    texts = (
        source.withColumn("clean", clean).withColumn("digest", digest(F.col("clean")))
        .join(small_side(hits, hits.count(), PLACE_BYTES), "digest")
        .withColumn("salt", F.pmod(F.xxhash64("_file", "_row"), F.col("slices")))
    )
    first = (texts.where((F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row")))
             .select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("salt"),
                     F.col("clean").alias("first_text")))
    clash = stored(
        texts.join(first, ["digest", "salt"]).where(F.col("clean") != F.col("first_text")).select("digest").distinct(),
        "dedup-clashes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")
    if clash.isEmpty():
        out = grouped
    else:
        several = texts.join(clash, "digest", "left_semi")
        by_text = several.groupBy("digest", "clean").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        out = grouped.join(clash, "digest", "left_anti").unionByName(
            several.drop("keep", "group_size").join(by_text, ["digest", "clean"])
            .select("digest", "doc_id", "_file", "_row", "keep", "group_size"))
    if digest is not sha256:
        strong = source.select("_file", "_row", sha256(clean).alias("text_sha256"))
        out = out.join(strong, ["_file", "_row"])
    else:
        out = out.withColumn("text_sha256", F.col("digest"))
    return out.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        ((F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))).alias("kept"),
        "text_sha256", "_file", "_row")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Only the places of dropped rows move."""
    docs = filed(docs)
    found = exact_groups(docs, doc_id, text)
    dropped = stored(found.where(~F.col("kept")).select("_file", "_row"), "dedup-dropped")
    placed = docs.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    stay = placed.join(small_side(dropped, dropped.count(), PLACE_BYTES), ["_file", "_row"], "left_anti")
    return stay.select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_file", "_row")


ORACLE = """
WITH clean AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), ranked AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place
  FROM clean
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
"""
