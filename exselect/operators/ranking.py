"""Selections that need only ids and scores: random, self, and the scaling of scores to costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exselect.operators.scoring import of_pairs


def seeded_order(seed: int, id_col: str):
    """Order of a seeded shuffle: a text hash that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def random_k(train: DataFrame, tests: DataFrame, k: int, seed: int) -> DataFrame:
    """k train ids drawn once per seed; every test row gets the same ones.

    Each task keeps its first k ids, so only k ids (a parameter) reach the driver.
    """
    order = seeded_order(seed, "train_id")
    picked = [row[0] for row in train.select("train_id").orderBy(order, "train_id").limit(k).collect()]
    place = F.posexplode(F.array(*[F.lit(i).cast("bigint") for i in picked]))
    return tests.select("test_id", place.alias("pos", "train_id")).select(
        F.lit(seed).alias("seed"), "test_id", (F.col("pos") + 1).alias("rank"), "train_id"
    )


def random_costs(selections: DataFrame, influence: DataFrame) -> DataFrame:
    """Scores of randomly drawn pairs, kept beside them as costs.

    The pair table is the large side: it is thinned out where it lies by the drawn pairs, counted, before it is joined. If it
    is still to be made, the train rows are thinned out before they are scored.
    """
    pairs = selections.select("test_id", "train_id").distinct()
    drawn = of_pairs(influence, pairs, selections.count())
    return selections.join(
        drawn.select("test_id", "train_id", F.col("score").alias("cost")).hint("shuffle_merge"),
        ["test_id", "train_id"], "left",
    )


def self_selection(tests: DataFrame) -> DataFrame:
    """The test row itself as its only example, at cost 0: the sanity check."""
    return tests.select(
        "test_id", F.lit(1).alias("rank"), F.col("test_id").alias("train_id"), F.lit(0.0).alias("cost")
    )


def min_max(df: DataFrame, keys: list[str], column: str, low: float, high: float, out: str) -> DataFrame:
    """Scale `column` to [low, high] within each ground set; a constant column becomes `low`.

    The windows hold one ground set each, at most m rows.
    """
    group = Window.partitionBy(*keys)
    least, most = F.min(column).over(group), F.max(column).over(group)
    span = F.when(most == least, F.lit(0.0)).otherwise((F.col(column) - least) / (most - least))
    return df.withColumn(out, F.lit(float(low)) + span * (high - low))


def extreme_selections(records: DataFrame, key: str, value: str) -> DataFrame:
    """The records with the single highest and lowest value per key, in one aggregation."""
    row = F.struct(*[F.col(c) for c in records.columns])
    both = records.groupBy(key).agg(
        F.max_by(row, F.col(value)).alias("highest"), F.min_by(row, F.col(value)).alias("lowest")
    )
    sides = F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("r")) for side in ("highest", "lowest")
    ]))
    return both.select(sides.alias("e")).select("e.side", "e.r.*")
