"""Curvature-corrected influence on blocked vectors, and the projections applied before storage.

Vectors stay flat, `vec ARRAY<DOUBLE>`; a layout lists the blocks as (name, first position, width), one
per weight tensor. Per block: lambda = mean over train of mean(g^2) / divisor and
h = v / lambda - (1 / (n lambda)) sum_i c_i g_i with c_i = (v . g_i) / (lambda + |g_i|^2).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exselect.operators.scoring import Batches, as_matrix, doubles, scan_against

Layout = list[tuple[str, int, int]]


def even_layout(width: int, blocks: int) -> Layout:
    """Equal slices b0, b1, ... over the whole width; the last one may be narrower."""
    step = -(-width // blocks)
    return [(f"b{i}", i * step, min(step, width - i * step)) for i in range(blocks) if i * step < width]


def to_blocks(vectors: DataFrame, id_col: str, layout: Layout) -> DataFrame:
    """Flat vectors to one row per (id, block)."""
    parts = F.array(*[
        F.struct(F.lit(name).alias("block"), F.slice(doubles(), start + 1, width).alias("vec"))
        for name, start, width in layout
    ])
    return vectors.select(id_col, F.explode(parts).alias("p")).select(id_col, "p.block", "p.vec")


def to_flat(blocks: DataFrame, id_col: str, layout: Layout) -> DataFrame:
    """Blocked vectors back to flat ones in layout order."""
    first = {name: start for name, start, _ in layout}
    place = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("block")]
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("at"), "vec")))
    return blocks.groupBy(id_col).agg(
        F.flatten(F.transform(ordered, lambda p: p["vec"])).alias("vec")
    )


def block_damping(train: DataFrame, layout: Layout, divisor: float = 10.0) -> DataFrame:
    """(block, lam): one JVM aggregation of squared columns, combined before the shuffle."""
    return _damping(train, layout, divisor).drop("n")


def _damping(train: DataFrame, layout: Layout, divisor: float) -> DataFrame:
    """(block, lam, n) with the number of train rows."""
    stats = train.select(
        Summarizer.metrics("normL2", "count").summary(array_to_vector(doubles())).alias("s")
    ).select(vector_to_array("s.normL2").alias("norm"), F.col("s.count").alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("block"), F.lit(start).alias("start"), F.lit(width).alias("width"))
        for name, start, width in layout
    ]))
    part = F.slice("norm", F.col("b.start") + 1, F.col("b.width"))
    squares = F.aggregate(part, F.lit(0.0), lambda total, x: total + x * x)
    return stats.select("norm", "n", each.alias("b")).select(
        "b.block", (squares / (F.col("n") * F.col("b.width")) / divisor).alias("lam"), "n"
    )


LEAST_TASKS = 4096
ROWS_PER_SUM = 64


def curvature_vectors(
    test: DataFrame, train: DataFrame, layout: Layout, divisor: float = 10.0, tasks: int | None = None
) -> DataFrame:
    """(test_id, vec) with vec = h over all blocks.

    Every task folds its train rows into one test-sized partial sum, added by the JVM summarizer. The train scan
    is coalesced (without a shuffle) so far that a sum stands for ROWS_PER_SUM times its own rows: what is
    shuffled stays a small share of the scan, and the number of tasks grows with the data.
    """
    # One value per weight tensor and one count: constants of the scan.
    found = list(_damping(train, layout, divisor).toLocalIterator())
    damping = {row["block"]: row["lam"] for row in found}
    total = found[0]["n"] if found else 0
    if tasks is None:
        tasks = max(LEAST_TASKS, total // (ROWS_PER_SUM * max(1, test.count())))

    def work(ids: np.ndarray, matrix: np.ndarray, batches: Batches) -> Iterator[pa.RecordBatch]:
        folded = np.zeros_like(matrix)
        for _, vectors in batches:
            for name, start, width in layout:
                cut = slice(start, start + width)
                g = vectors[:, cut]
                share = (matrix[:, cut] @ g.T) / (damping[name] + np.square(g).sum(axis=1))
                folded[:, cut] += share @ g
        yield pa.RecordBatch.from_pydict({
            "test_id": pa.array(ids, pa.int64()),
            "vec": pa.array(list(folded), pa.list_(pa.float64())),
        })

    folded = scan_against(test, train.coalesce(tasks), work, "test_id bigint, vec array<double>")
    sums = folded.groupBy("test_id").agg(
        Summarizer.sum(array_to_vector("vec")).alias("s")
    ).select("test_id", vector_to_array("s").alias("folded"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lam = np.concatenate([np.full(width, damping[name]) for name, _, width in layout])
        for batch in batches:
            if batch.num_rows:
                h = as_matrix(batch["vec"]) / lam - as_matrix(batch["folded"]) / (total * lam)
                yield pa.RecordBatch.from_pydict({
                    "test_id": batch["test_id"], "vec": pa.array(list(h), pa.list_(pa.float64())),
                })

    return test.select("test_id", doubles().alias("vec")).join(sums, "test_id").mapInArrow(
        finish, "test_id bigint, vec array<double>"
    )


def projection_budget(blocks: DataFrame, budget: int = 8192, unit: int = 512) -> DataFrame:
    """Add proj_dim to blocks(block, dim): the budget shared by width, rounded to the unit.

    The table has one row per weight tensor, so the global window is a handful of rows.
    """
    share = F.least(
        F.col("dim"), F.floor(F.lit(budget) * F.col("dim") / F.sum("dim").over(Window.partitionBy()))
    )
    rounded = F.greatest(F.lit(unit), F.bround(share / unit) * unit)
    return blocks.withColumn("share", share).withColumn(
        "proj_dim", F.when(F.col("share") <= unit, F.col("dim")).otherwise(rounded).cast("bigint")
    )


# Fixed values of the sign generator: a prime under 2^31, so that products of two residues fit 64 bits, and the start of the column keys.
PRIME = 2_147_483_647
SIGN_STEPS = (48_271, 69_621, 1_664_525)
TILE_SIGNS = 1 << 21  # signs that a task holds at once


def sign_columns(seed: int, block: str, columns: np.ndarray) -> np.ndarray:
    """Four coefficients below PRIME for each column of a block, from seed, block and column alone: (columns, 4)."""
    base = (seed * SIGN_STEPS[0] + zlib.crc32(block.encode())) % PRIME
    key = (np.asarray(columns, np.int64)[:, None] * 4 + np.arange(4) + base) % PRIME
    for step in SIGN_STEPS:  # two squarings would do; the third parts neighbours further
        key = (key * key % PRIME + key * step % PRIME + step) % PRIME
    return key


def sign_tile(coefficients: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Signs +-1 at the given rows: (rows, columns). The parity of a cubic polynomial of the row, so any four rows of a
    column are as good as independent."""
    x = (np.asarray(rows, np.int64)[:, None] + 1) % PRIME
    value = np.broadcast_to(coefficients[None, :, 0], (len(x), len(coefficients)))
    for k in (1, 2, 3):
        value = (value * x + coefficients[None, :, k]) % PRIME
    return 1.0 - 2.0 * (value & 1)


def sign_matrix(seed: int, block: str, width: int, dim: int) -> np.ndarray:
    """The whole random +-1 matrix of a block, scaled by 1/sqrt(dim); tasks make tiles of it only."""
    return sign_tile(sign_columns(seed, block, np.arange(dim)), np.arange(width)) / math.sqrt(dim)


def _signed(rows: np.ndarray, seed: int, block: str, dim: int) -> np.ndarray:
    """rows @ sign_matrix, tile by tile."""
    out = np.zeros((len(rows), dim))
    wide = max(1, min(dim, TILE_SIGNS // 64))
    for first in range(0, dim, wide):
        coefficients = sign_columns(seed, block, np.arange(first, min(dim, first + wide)))
        high = max(1, TILE_SIGNS // len(coefficients))
        for start in range(0, rows.shape[1], high):
            part = rows[:, start:start + high]
            out[:, first:first + wide] += part @ sign_tile(coefficients, np.arange(start, start + part.shape[1]))
    return out / math.sqrt(dim)


def sign_projection(
    vectors: DataFrame, id_col: str, layout: Layout, dims: dict[str, int], seed: int = 42
) -> DataFrame:
    """Project each block to dims[block] columns; a block keeping its width is left as it is.

    A sign follows from seed, block, row and column alone. No task holds more than TILE_SIGNS of them, whatever the width.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = as_matrix(batch["vec"])
                parts = [
                    _signed(rows[:, start:start + width], seed, name, dims[name]) if dims[name] < width
                    else rows[:, start:start + width]
                    for name, start, width in layout
                ]
                yield pa.RecordBatch.from_pydict({
                    id_col: batch[id_col],
                    "vec": pa.array(list(np.hstack(parts)), pa.list_(pa.float64())),
                })

    return vectors.select(id_col, doubles().alias("vec")).mapInArrow(
        project, f"{id_col} bigint, vec array<double>"
    )


def low_precision(vectors: DataFrame, id_col: str, kind: str = "float") -> DataFrame:
    """Storage form: 32-bit floats, or floats rounded half-even to bfloat16."""
    if kind == "float":
        return vectors.select(id_col, F.col("vec").cast("array<float>").alias("vec"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = as_matrix(batch["vec"]).astype(np.float32).view(np.uint32)
                bits = (bits + 0x7FFF + ((bits >> 16) & 1)) & np.uint32(0xFFFF0000)
                yield pa.RecordBatch.from_pydict({
                    id_col: batch[id_col],
                    "vec": pa.array(list(bits.view(np.float32)), pa.list_(pa.float32())),
                })

    return vectors.select(id_col, doubles().alias("vec")).mapInArrow(
        shorten, f"{id_col} bigint, vec array<float>"
    )
