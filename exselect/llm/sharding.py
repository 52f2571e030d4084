"""Global shuffle into shards of equal row counts in two passes over external storage (operator 11).

Pass one scatters records uniformly over buckets of a bounded size, by a seeded hash of each record's place. Pass two
takes one bucket at a time, draws a Fisher-Yates permutation of it from a generator seeded with the bucket's number,
and writes it. The order of the whole table is that of the buckets one after another; shards are equal cuts of it.
Every step follows from seed and place of the records, so a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exselect.llm.exact_dedup import filed
from exselect.llm.tables import measured_side, parts, shared_folder, stored

BUCKET_BYTES = 64 << 20
BLOCK = 1 << 12  # buckets numbered by one task
SEED = 20_259


def fisher_yates(n: int, draw: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): the last place is filled from all, the one before from those left, and so on."""
    order = list(range(n))
    left = np.arange(n, 1, -1)
    for place, pick in zip((left - 1).tolist(), draw.integers(0, left).tolist()):
        order[place], order[pick] = order[pick], order[place]
    return np.array(order, np.int64)


def _starts(placed: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, start): rows in all buckets before; and the number of rows. Blocks of buckets are summed first, then each block's own."""
    counts = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "shuffle-counts")
    block = F.floor(F.col("bucket") / BLOCK)
    blocks = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("blocks_before"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = starts.join(blocks, "block").select("bucket", (F.col("blocks_before") + F.col("inside")).alias("start"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stored(starts, "shuffle-starts"), total


def shuffled_order(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, row_bytes: Column | None = None) -> tuple[DataFrame, int]:
    """(row, place) in an order drawn at random over the whole table, `row` a struct of all columns; and the number of rows.

    `row_bytes` tells the size of a row (by default that of its string and binary columns). Partitions are in the order
    of places, and so are the rows of each.
    """
    docs = filed(docs)
    spark = docs.sparkSession
    if row_bytes is None:
        texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")]
        row_bytes = sum(texts, F.lit(8 * len(docs.columns)))
    size = docs.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    tasks = parts(spark)
    buckets = tasks * max(1, -(-size // (tasks * bucket_bytes)))
    per_task = buckets // tasks
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    chance, tie = F.xxhash64(F.lit(seed), *place), F.xxhash64(F.lit(~seed), *place)
    bucket = F.pmod(chance, F.lit(buckets))
    starts, total = _starts(docs.select(bucket.alias("bucket")))
    rows = docs.select(F.struct("*").alias("row"), bucket.alias("bucket"), chance.alias("chance"), tie.alias("tie"))
    rows = rows.join(measured_side(starts, F.lit(16)), "bucket")
    dealt = rows.repartitionById(tasks, F.floor(F.col("bucket") / per_task).cast("int")).sortWithinPartitions("bucket", "chance", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(pieces)
            order = fisher_yates(table.num_rows, np.random.Generator(np.random.Philox(key=[seed, table["bucket"][0].as_py()])))
            first = table["start"][0].as_py()
            for k in range(0, len(order), 512):  # 512 rows at a time leave the task
                rows = pa.concat_arrays(table["row"].take(pa.array(order[k:k + 512])).chunks)
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.arange(first + k, first + k + len(rows)))], names=["row", "place"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[-1].column(1)[0] != batch.column(1)[a]:
                    yield from flush(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held)

    schema = dealt.select("row", F.lit(0).cast("long").alias("place")).schema
    return dealt.select("row", "bucket", "start").mapInArrow(run, schema), total


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows, shuffled, into `path`/shard=0 and so on, and return the written table with `shard` and `slot`.

    Row counts of shards differ by one at most; slots run from 0 without a gap, and files in order of their names hold
    rows in order of slots. A row is told by its place in the input, so rows that are repeated, have null columns or
    empty or very long texts are rows like any other and each is written once. An empty table gives an empty result.
    Columns of the input named shard or slot are replaced; other names may be anything.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    order, total = shuffled_order(docs.select(*[F.col(f"`{c}`") for c in kept]), seed, bucket_bytes)
    cut = order.withColumn("shard", F.expr(f"place * {shards}L div {max(total, 1)}L").cast("int"))
    # The first place of shard s is s x total / shards, rounded up.
    slot = F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = cut.select("row.*", slot.cast("long").alias("slot"), "shard").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op11_shuffled_shards(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Documents, shuffled and dealt into shards by row count; equal texts are separate rows. A null text has no bytes and crc32 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return write_shards(docs, shared_folder(spark, "shuffled-shards"), shards).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
