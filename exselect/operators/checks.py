"""Completeness and quality checks of merged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORING_KEYS = ["model", "explanation_type", "train_dataset", "train_split", "test_dataset", "test_split",
                "estimator", "linear_coder"]
VALIDATION_KEYS = SCORING_KEYS[:-1]
SETTING_KEYS = ["explanation_type", "model", "estimator"]


def incomplete_groups(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Groups whose row count differs from the number of test rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def missing_settings(left: DataFrame, right: DataFrame, keys: list[str] = SETTING_KEYS) -> DataFrame:
    """Distinct keys of `left` without any row in `right`."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def missing_by_column(missing: DataFrame, keys: list[str] = SETTING_KEYS) -> DataFrame:
    """The missing keys column by column: (column, value)."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("value")) for k in keys
    ]))
    return missing.select(each.alias("e")).select("e.*").distinct()


def setting_count(df: DataFrame, keys: list[str] = SETTING_KEYS) -> DataFrame:
    """One row: number of distinct settings. Settings are deduplicated in the tasks first."""
    return df.select(*keys).distinct().agg(F.count("*").alias("settings"))


def require_settings(df: DataFrame, expected: int, keys: list[str] = SETTING_KEYS) -> DataFrame:
    """One row if the number of settings is as expected; the job fails otherwise."""
    return setting_count(df, keys).where(
        F.when(F.col("settings") == expected, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"expected {expected} settings, found "), F.col("settings").cast("string")))
            .cast("boolean")
        )
    )


def both_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which no listed column is null or NaN."""
    kinds = dict(df.dtypes)
    out = df.dropna(subset=columns)
    for name in columns:
        if kinds[name] in ("double", "float"):
            out = out.where(~F.isnan(name))
    return out
