"""Sampled splits, exact row numbers without a global sort task, and the split summary."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exselect.operators.ranking import seeded_order
from exselect.session import cut_lineage, union_all


def with_index(df: DataFrame, *order: str | Column, out: str = "idx") -> DataFrame:
    """Add the 0-based position in the given total order.

    Rows are range-partitioned and sorted per partition; the checkpoint freezes the partitions, whose
    sizes (one row per partition) then give each of them its offset.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        out, F.col("_offset") + local
    ).drop("_at", "_part", "_offset")


def split_size(total: int, value: float) -> int:
    """A value in (0, 1] is a share, a larger one a number of rows."""
    if value <= 0:
        raise ValueError("split sizes must be positive")
    return int(total * value) if value <= 1 else min(int(value), total)


def take_split(
    df: DataFrame, id_col: str, sizes: dict[str, float], seed: int = 42, disjoint: bool = True
) -> DataFrame:
    """Rows of the named splits with a `split` column, exact sizes.

    disjoint=True cuts one seeded order into consecutive pieces. disjoint=False draws each split on its
    own with seed + 42 i, so a row may be in several. Only ids are ordered; the rows themselves are filtered.
    """
    total = df.count()
    counts = {name: split_size(total, value) for name, value in sizes.items()}
    if disjoint:
        ends = list(accumulate(counts.values()))
        name = F.lit(None).cast("string")
        df, before = _placed(df, id_col, seed, ends, total)
        for split, inside in reversed([*zip(counts, before)]):
            name = F.when(inside, F.lit(split)).otherwise(name)
        return df.withColumn("split", name).where(F.col("split").isNotNull()).drop("idx")
    parts = []
    for i, (split, n) in enumerate(counts.items()):
        rows, (inside,) = _placed(df, id_col, seed + 42 * i, [n], total)
        parts.append(rows.where(inside).drop("idx").withColumn("split", F.lit(split)))
    return union_all(parts)


def _placed(df: DataFrame, id_col: str, seed: int, ends: list[int], total: int) -> tuple[DataFrame, list[Column]]:
    """The rows, and per end the condition of being among that many first ones of the seeded order.

    Two ids per end come to the driver: the last one inside and the first one beyond. If an id that stands in
    several rows meets an end, its rows have no order by id, so all rows are numbered instead.
    """
    order = seeded_order(seed, id_col)
    ids = with_index(df.select(order.alias("_order"), id_col), "_order", id_col)
    cuts = [end for end in ends if end < total]
    found = {row["idx"]: (row["_order"], row[id_col]) for row in
             ids.where(F.col("idx").isin([*cuts, *(cut - 1 for cut in cuts)])).collect()}
    if any(found[cut] == found.get(cut - 1) or found[cut][0] is None for cut in cuts):
        rows = with_index(df.withColumn("_order", order), "_order", id_col).drop("_order")
        return rows, [F.col("idx") < end for end in ends]
    conditions = []
    for end in ends:
        if end >= total:
            conditions.append(F.lit(True))
            continue
        text, key = found[end]
        earlier = (order < text) | ((order == text) & (F.col(id_col) < key))
        conditions.append(F.coalesce(earlier, F.lit(True)))  # a null id comes first
    return df, conditions


def hash_split(df: DataFrame, id_col: str, share: float, seed: int = 42, names=("test", "train")) -> DataFrame:
    """Label every row by its own hash: the first name gets about `share` of them. No shuffle at all."""
    limit = f"{min(int(share * 16 ** 8), 16 ** 8 - 1):08x}"
    low = F.substring(seeded_order(seed, id_col), 1, 8) < limit
    return df.withColumn("split", F.when(low, F.lit(names[0])).otherwise(F.lit(names[1])))


def select_split(df: DataFrame, spec: str, split_col: str = "split", index_col: str = "idx") -> DataFrame:
    """Rows of "train" or of a slice "train[0:100]" by row number."""
    name, low, high = re.fullmatch(r"(\w+)(?:\[(\d*):(\d*)\])?", spec).groups()
    out = df.where(F.col(split_col) == name)
    if low:
        out = out.where(F.col(index_col) >= int(low))
    if high:
        out = out.where(F.col(index_col) < int(high))
    return out


def split_summary(splits: DataFrame, source_rows: int) -> DataFrame:
    """(split, n, share of the source)."""
    return splits.groupBy("split").agg(F.count("*").alias("n")).withColumn(
        "share", F.col("n") / F.lit(source_rows)
    )
