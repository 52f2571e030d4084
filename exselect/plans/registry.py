"""Registry of named queries over the given tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.functions import chat
from exselect.functions.labels import MODELS, ORDER_TEXT, SANITY_TEXT, describe
from exselect.sources.readers import read_table
from exselect.sources.splits import hash_split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may start with common table expressions of this module."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# --- vectors -----------------------------------------------------------------------------------

TEST_SHARE = 0.2
_LIMIT = f"{int(TEST_SHARE * 16 ** 8):08x}"

VECTORS_SQL = f"""
v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec,
             substr(md5('42:' || vec_id::VARCHAR), 1, 8) < '{_LIMIT}' AS is_test FROM embeddings),
te AS (SELECT id AS test_id, vec FROM v WHERE is_test),
tr AS (SELECT id AS train_id, vec FROM v WHERE NOT is_test)"""
INFLUENCE_SQL = VECTORS_SQL + """,
inf AS (SELECT test_id, train_id, round(-list_dot_product(te.vec, tr.vec), 9) AS score FROM te, tr)"""
SQL_KEYS = {"most_helpful": "score", "most_harmful": "-score", "least_influential": "abs(score)",
            "most_influential": "-abs(score)"}
DIGITS = 9  # scores are compared after this rounding on both sides


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(test, train) vectors: every row of `embeddings` is in one of them."""
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    rows = hash_split(rows, "id", TEST_SHARE)
    test = rows.where("split = 'test'").select(F.col("id").alias("test_id"), "vec")
    train = rows.where("split = 'train'").select(F.col("id").alias("train_id"), "vec")
    return test, train


# --- texts -------------------------------------------------------------------------------------

def sql_terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(train_id, terms) of every whole document."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("train_id"), "text")
    return chat.tokenize(docs, max_len=None).select("train_id", "terms")


def benchmark_items(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("test_id"), "text")
    return chat.tokenize(items, max_len=None).select("test_id", "terms")


# --- records: one scoring and one validation record per order line ---------------------------------

def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {arms} ELSE {values[-1]} END"


_MODEL = _case("l_orderkey % 3", [f"'{m}'" for m in MODELS])
# Estimator names as records carry them.
ESTIMATORS = ("LESSEstimator: normalize=True", "DataInfEstimator: fast_implementation=True",
              "BM25Estimator: k1=1.5, b=0.75")
_ESTIMATOR = _case("(l_orderkey % 9 - l_orderkey % 3) % 7", [f"'{ESTIMATORS[0]}'", "''", "''", f"'{ESTIMATORS[1]}'",
                                                            "''", "''", f"'{ESTIMATORS[2]}'"])
_K = _case("l_orderkey % 4", ["'1'", "'5'", "'10'", "'25'"])
_ORDER = _case("l_partkey % 4", [f"'{text}'" for text in ORDER_TEXT.values()])
_LAMBDA = _case("l_suppkey % 5", ["'0.0'", "'0.25'", "'0.5'", "'0.75'", "'1.0'"])
_SEED = _case("l_suppkey % 5", ["'42'", "'10'", "'3'", "'9'", "'6'"])
_TEXT = f"""CASE l_linenumber
  WHEN 1 THEN concat({_K}, ' random examples with seed ', {_SEED})
  WHEN 2 THEN concat('Top-', {_K}, ' ', {_ORDER})
  WHEN 3 THEN concat({_K}, ' by facility location from Top-100 ', {_ORDER}, '. lambda=', {_LAMBDA})
  WHEN 4 THEN concat('Top-', {_K}, ' by facility location from Top-100 ', {_ORDER}, '. lambda=', {_LAMBDA})
  WHEN 5 THEN concat({_K}, ' by DIVINE from Top-100 ', {_ORDER}, '.')
  WHEN 6 THEN concat({_K}, ' by AIDE from Top-100.')
  ELSE CASE l_suppkey % 2 WHEN 0 THEN '{SANITY_TEXT}' ELSE concat('Top-', {_K}, ' ', {_ORDER}) END END"""
_TEXT_COLUMN = f"{_TEXT} AS explanation_type"
_KEYS = [
    "l_orderkey AS document_idx", f"{_MODEL} AS model", f"{_ESTIMATOR} AS estimator", "'mixture' AS train_dataset",
    "'train' AS train_split", "'mixture' AS test_dataset", "'test' AS test_split", _TEXT_COLUMN,
]
SCORING_COLUMNS = [
    *_KEYS, "CASE l_returnflag WHEN 'A' THEN 'MSECoderProjUSimp' WHEN 'N' THEN 'MSECoder' ELSE 'KLTCoder' END AS linear_coder",
    "l_extendedprice / 23457.0 AS pred_gain", "l_discount AS mse", "l_quantity AS l1", "l_tax * l_quantity AS l2",
    "l_discount - 0.05 AS t0", "l_tax AS t1", "l_tax - l_discount AS t2",
]
VALIDATION_COLUMNS = [
    *_KEYS, "l_extendedprice / 23457.0 - l_quantity / 10.0 AS delta_log_p", "l_tax + 0.01 AS jsd", "l_discount AS kld",
]


def sql_records(name: str, columns: list[str]) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM lineitem)"


SCORING_SQL = sql_records("scoring", SCORING_COLUMNS)
VALIDATION_SQL = sql_records("validation", VALIDATION_COLUMNS)


_SETTING_KEYS = {"l_linenumber": range(1, 8), "l_orderkey % 4": range(4), "l_partkey % 4": range(4),
                 "l_suppkey % 10": range(10)}


def _descriptions(spark: SparkSession) -> DataFrame:
    """The 1120 settings an order line can have, with their descriptions: a dimension table."""
    rows = []
    for line, k, order, supplier in itertools.product(*_SETTING_KEYS.values()):
        method = ("random", "top_k", "facility_location", "facility_location", "divine", "aide",
                  "top_k" if supplier % 2 else "self")[line - 1]
        rows.append((line, k, order, supplier, method, list(ORDER_TEXT)[order], (1, 5, 10, 25)[k], 100,
                     (0.0, 0.25, 0.5, 0.75, 1.0)[supplier % 5], (42, 10, 3, 9, 6)[supplier % 5]))
    table = spark.createDataFrame(
        rows, "s0 int, s1 int, s2 int, s3 int, method string, sort_type string, k int, m int, lambda double, seed int"
    )
    text = describe(*[F.col(c) for c in ("method", "sort_type", "k", "m", "lambda", "seed")])
    # One kind of line carries the stray prefix that older results have.
    text = F.when(F.col("s0") == 4, F.concat(F.lit("Top-"), text)).otherwise(text)
    return table.select("s0", "s1", "s2", "s3", text.alias("explanation_type"))


def _records(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    keys = [f"CAST({key} AS INT) AS s{i}" for i, key in enumerate(_SETTING_KEYS)]
    lines = read_table(spark, sf, "lineitem").selectExpr("*", *keys)
    joined = lines.join(F.broadcast(_descriptions(spark)), ["s0", "s1", "s2", "s3"])
    return joined.selectExpr(*["explanation_type" if c == _TEXT_COLUMN else c for c in columns])


def scoring_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, SCORING_COLUMNS).withColumn("t", F.array("t0", "t1", "t2")).drop("t0", "t1", "t2")


def validation_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, VALIDATION_COLUMNS)
