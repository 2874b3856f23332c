"""Registered queries against their SQL. All of them with GRITSIEVE_ALL=1; by default one of each kind."""

import os

import pytest

import __spark_entry__ as entry
from catalog.check import compare, oracle_connection
from catalog.oracles import ORACLES
from catalog.queries import CLEANING, QUERIES, learned

FOLDER = "/root/testdata/sf0.001"
EACH_KIND = [
    "fn_number", "clean_coerce_datetime", "profile_columns", "scorecard", "detect_two_row_header", "scan", "plan_blocked",
    "replay_clean", "roles", "chart_box_by_group", "findings", "questions", "sql_readonly", "load_delimited",
    "rank_candidate_tables", "stream_quality_window", "load_multiline", "load_names", "duplicate_count_floats",
    "auto_apply_real_values", "finding_headlines", "chart_suggestions",
]
NAMES = list(QUERIES) if os.environ.get("GRITSIEVE_ALL") else EACH_KIND

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, oracle, name):
    assert compare(spark, oracle, name, FOLDER) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(entry.oracle_sql()) >= set(QUERIES)


def test_the_written_recipe_is_the_learned_one(spark):
    _, recipe = learned(spark, FOLDER)
    assert [(s.op, s.params) for s in recipe.steps] == [(s.op, s.params) for s in CLEANING.steps]


def test_flagship(spark):
    card = {r["measure"]: r for r in entry.entry(spark).collect()}
    assert card["score"]["after"] > card["score"]["before"] and card["duplicate_rows"]["after"] == 0
