"""Shuffled shards: the law, every row once, and the order against a plain two-pass shuffle."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exselect.llm import sharding


def _rows(spark, n):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else i % (n // 2 + 1), rng.choice([None, "", "x" * rng.randrange(200), "same"]), i, 7.0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, slot int, bucket double").repartition(3)


@pytest.mark.parametrize("n,shards,size", [(1000, 24, 1 << 26), (1000, 7, 500), (5, 24, 100), (1, 1, 1)])
def test_shards_follow_the_law(spark, tmp_path, n, shards, size):
    df = _rows(spark, n)
    out = sharding.write_shards(df, str(tmp_path / "shards"), shards, bucket_bytes=size)
    assert set(out.columns) == {"doc_id", "text", "bucket", "slot", "shard"}
    rows = out.collect()
    key = lambda r: (r.doc_id, r.text, r.bucket)
    assert collections.Counter(map(key, rows)) == collections.Counter(map(key, df.collect()))
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for shard, count in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(count))


def test_files_hold_slots_in_order(spark, tmp_path):
    out = sharding.write_shards(_rows(spark, 2000), str(tmp_path / "shards"), 5, bucket_bytes=300)
    placed = out.select("shard", "slot", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    for shard in range(5):
        rows = sorted(placed.where(F.col("shard") == shard).collect(), key=lambda r: (r.file, r.row))
        assert [r.slot for r in rows] == list(range(400))


def test_order_is_the_plain_two_pass_shuffle_and_comes_again(spark, tmp_path):
    """Buckets by seeded hash in order of the hash, then a Fisher-Yates shuffle of each: the same rows in the same places."""
    path = str(tmp_path / "docs")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    buckets = 4 * -(-3000 * 25 // (4 * 2000))
    hashes = docs.select("doc_id", *[F.xxhash64(F.lit(s), "_metadata.file_path", "_metadata.row_index").alias(n) for s, n in ((5, "h"), (~5, "t"))]).collect()
    held = collections.defaultdict(list)
    for r in sorted(hashes, key=lambda r: (r.h, r.t)):
        held[r.h % buckets].append(r.doc_id)
    want = []
    for bucket in sorted(held):
        rows, draw = held[bucket], np.random.Generator(np.random.Philox(key=[5, bucket]))
        for last, pick in zip(range(len(rows) - 1, 0, -1), draw.integers(0, np.arange(len(rows), 1, -1)).tolist()):
            rows[last], rows[pick] = rows[pick], rows[last]
        want += rows
    order, total = sharding.shuffled_order(docs, 5, 2000)
    assert total == 3000 and [r.row.doc_id for r in order.orderBy("place").collect()] == want
    other, _ = sharding.shuffled_order(docs, 6, 2000)
    assert [r.row.doc_id for r in other.orderBy("place").collect()] != want


def test_permutations_are_uniform():
    draw = np.random.Generator(np.random.Philox(key=[1, 1]))
    seen = collections.Counter(tuple(sharding.fisher_yates(4, draw).tolist()) for _ in range(24_000))
    assert len(seen) == 24 and sum((n - 1000) ** 2 / 1000 for n in seen.values()) < 60  # 23 degrees of freedom


def test_no_rows(spark, tmp_path):
    out = sharding.write_shards(_rows(spark, 10).limit(0), str(tmp_path / "shards"))
    assert out.count() == 0 and "shard" in out.columns
