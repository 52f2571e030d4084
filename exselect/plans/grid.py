"""The grid of settings: methods x orders x k x lambda x seed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.functions.labels import describe
from exselect.operators.scoring import SORT_TYPES

# Fixed values of the published grid.
KS = (1, 5, 10, 25)
LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)
SEEDS = (42, 10, 3, 9, 6)
GROUND_SIZE = 100
# Scores that cannot be negative have no helpful or harmful side.
SIGNLESS_ORDERS = ("least_influential", "most_influential")

FIELDS = "method string, sort_type string, k int, m int, lambda double, seed int"


def settings(
    spark: SparkSession, ks=KS, lambdas=LAMBDAS, seeds=SEEDS, m: int = GROUND_SIZE, signed: bool = True
) -> DataFrame:
    """One row per setting with its description; k > m is skipped."""
    orders = SORT_TYPES if signed else SIGNLESS_ORDERS
    rows = [("self", None, 1, None, None, None)]
    rows += [("top_k", order, k, None, None, None) for order in orders for k in ks]
    rows += [("random", None, k, None, None, seed) for k in ks for seed in seeds]
    fitting = [k for k in ks if k <= m]
    rows += [("facility_location", o, k, m, float(lam), None) for o in orders for k in fitting for lam in lambdas]
    rows += [("divine", order, k, m, None, None) for order in orders for k in fitting]
    rows += [("aide", "most_influential", k, m, None, None) for k in fitting]
    grid = spark.createDataFrame(rows, FIELDS)
    return grid.withColumn("selection", describe(*[
        F.col(c) for c in ("method", "sort_type", "k", "m", "lambda", "seed")
    ]))


def full_grid(spark: SparkSession, models: list[str], signed: list[str], signless: list[str]) -> DataFrame:
    """Settings of every (model, estimator)."""

    def spread(grid: DataFrame, estimators: list[str]) -> DataFrame:
        for name, values in (("estimator", estimators), ("model", models)):
            grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        return grid

    return spread(settings(spark), signed).unionByName(spread(settings(spark, signed=False), signless))


def settings_of_tests(tests: DataFrame, grid: DataFrame) -> DataFrame:
    """Every setting for every test row. The grid is parameters, a few hundred rows, so it is a constant."""
    rows = json.dumps([row.asDict() for row in grid.collect()])
    kind = "array<struct<" + ", ".join(f"`{n}`: {t}" for n, t in grid.dtypes) + ">>"
    each = F.explode(F.from_json(F.lit(rows), kind))
    return tests.select("test_id", each.alias("s")).select("test_id", "s.*")
