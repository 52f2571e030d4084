"""Registered queries against their SQL twins on the smallest data, where the data is there."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import TABLES, _differ, canonical

SF = "/root/testdata/sf0.001"
# One query per family; tools/check.py runs all of them.
CHOSEN = [
    "dot_top_most_influential", "curvature_top_most_helpful", "bm25_reference_top_least_influential",
    "facility_location_most_helpful", "divine_most_influential", "aide_picks", "coder_scores_of_pairs",
    "explained_share_least_squares", "render_chat", "assistant_labels_by_first_match", "answer_grading",
    "description_labels", "selection_against_random", "rank_correlation_overall", "gain_area_over_k",
    "task_score_matrix", "missing_settings",
]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    mine = canonical(entry_points.queries()[name](spark, SF).toPandas())
    other = canonical(db.execute(entry_points.oracle_sql()[name]).df())
    assert list(mine.columns) == list(other.columns) and len(mine) == len(other)
    wrong = [(p, q) for p, q in zip(mine.values, other.values) if any(_differ(x, y) for x, y in zip(p, q))]
    assert not wrong[:3]


@needs_data
def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.count() > 0 and "pred_gain" in rows.columns


def test_twins_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
