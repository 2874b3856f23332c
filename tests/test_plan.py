import json

import pytest

from gritsieve.operators.registry import OPERATIONS, stage_dimension, stage_of
from gritsieve.plans import plan as planning
from gritsieve.plans.plan import Step, check_order, guard_step
from gritsieve.plans.recipe import Recipe
from gritsieve.relations import FINDINGS, local_relation


def findings(spark, *items):
    """(kind, column, confidence, op, params) rows."""
    return local_relation(spark, [
        {"kind": k, "column": c, "confidence": conf, "n_affected": 1, "detail": "why", "op": op,
         "params": json.dumps(params) if params is not None else None}
        for k, c, conf, op, params in items
    ], FINDINGS)


PROTECTED = [
    ("structural_missing", "Q9", 0.9, None, None),
    ("multiselect_group", "Q7", 0.9, "collapse_multiselect", {"stem": "Q7", "members": ["Q7_Part_1", "Q7_Part_2", "Q7_Part_3"]}),
]


def test_stages_explain_themselves(spark):
    stages = stage_dimension(spark).orderBy("stage").collect()
    assert [s["name"] for s in stages] == [
        "STRUCTURE", "SENTINEL", "TYPES", "STANDARDISE", "DEDUPLICATE", "MISSING", "OUTLIERS", "VALIDATE", "PRIVACY"
    ]
    assert all(len(s["why"]) > 25 for s in stages)
    with pytest.raises(KeyError):
        stage_of("nothing")


def test_order(spark):
    good = ["collapse_multiselect", "recode_sentinel_missing", "coerce_numeric", "strip_whitespace", "drop_duplicates", "fill_missing"]
    assert check_order(spark, good) == []
    assert "strip_whitespace" in check_order(spark, ["drop_duplicates", "strip_whitespace"])[0]
    assert check_order(spark, ["coerce_numeric", "recode_sentinel_missing"])
    assert check_order(spark, ["not_an_operator"]) == []
    assert len(check_order(spark, ["drop_duplicates", "strip_whitespace", "coerce_numeric", "fill_missing"])) == 2


def test_never_impute(spark):
    got = {r["column"] for r in planning.never_impute(findings(spark, *PROTECTED)).collect()}
    assert got == {"Q9", "Q7", "Q7_Part_1", "Q7_Part_2", "Q7_Part_3"}


def test_guards(spark):
    fill = lambda c: ("x", c, 0.99, "fill_missing", {"column": c, "method": "mode"})
    clip = lambda lo, hi: ("x", "age", 0.9, "clip_outliers", {"column": "age", "lower": lo, "upper": hi})
    plan = planning.build_plan(findings(spark, *PROTECTED, fill("Q9"), fill("Q7_Part_3"), fill("age"), clip(120, 0), clip(0, 120)))
    got = {(r["op"], r["target"], r["blocked"] is None) for r in plan.collect()}
    assert {("fill_missing", "Q9", False), ("fill_missing", "Q7_Part_3", False), ("fill_missing", "age", True)} <= got
    assert sum(r["blocked"] is not None for r in plan.collect()) == 3
    assert "never asked" in guard_step(Step("fill_missing", {"column": "Q9"}), {"Q9"})
    assert guard_step(Step("fill_missing", {"column": "age"}), {"Q9"}) is None
    assert guard_step(Step("clip_outliers", {"column": "age", "lower": 120, "upper": 0}), set())


def test_the_less_certain_of_two_rivals_is_blocked(spark):
    plan = planning.build_plan(findings(
        spark,
        ("date_like", "Age", 0.86, "coerce_datetime", {"column": "Age"}),
        ("numeric_like", "Age", 0.95, "coerce_numeric", {"column": "Age"}),
        ("date_like", "Other", 0.86, "coerce_datetime", {"column": "Other"}),
        ("pii", "id", 0.8, "deidentify", {"column": "id", "method": "hash"}),
        ("x", "id", 0.7, "drop_column", {"column": "id"}),
        ("x", "zip", 0.8, "deidentify", {"column": "zip"}),
        ("y", "zip", 0.7, "deidentify", {"column": "zip"}),
    ))
    blocked = {(r["op"], r["target"]): r["blocked"] for r in plan.collect() if r["blocked"]}
    assert set(blocked) == {("coerce_datetime", "Age"), ("drop_column", "id")}
    assert "contradicts coerce_numeric" in blocked[("coerce_datetime", "Age")]


def test_plan_order_and_unattended_steps(spark):
    plan = planning.build_plan(findings(
        spark, *PROTECTED,
        ("duplicate_rows", "<table>", 0.95, "drop_duplicates", {}),
        ("sentinel_missing", "age", 0.6, "recode_sentinel_missing", {"column": "age", "values": ["99"]}),
        ("constant_columns", "a, b", 0.9, "drop_constant_columns", {"columns": ["a", "b"]}),
        ("made_up", "age", 0.99, "not_an_operator", {"column": "age"}),
    ))
    got = plan.orderBy("step").collect()
    assert [r["op"] for r in got] == ["collapse_multiselect", "drop_constant_columns", "recode_sentinel_missing", "drop_duplicates"]
    assert [r["target"] for r in got] == ["Q7", "a, b", "age", "<table>"]
    assert [r["stage"] for r in got] == sorted(r["stage"] for r in got)
    assert {r["op"] for r in planning.auto_apply(plan).collect()} == {"collapse_multiselect", "drop_constant_columns", "drop_duplicates"}
    assert all(s.op in OPERATIONS for s in planning.steps_of(plan))


def test_a_ledger_of_four_dropping_steps_takes_two_passes(spark, frame, monkeypatch):
    """Counts equal those of running the steps one after the other."""
    data = [("what is your a?", "what is your b?"), ("a", "b"), ("1", "x"), ("1", "x"), (None, None), ("a", "b"), ("999", "y"), (None, None), ("2", None)]
    df = frame({"a": ("string", [r[0] for r in data]), "b": ("string", [r[1] for r in data])})
    steps = [
        Step("promote_header_row", {"drop_rows": 1}), Step("drop_repeated_header_rows"), Step("drop_empty_rows"),
        Step("recode_sentinel_missing", {"column": "a", "values": ["999"], "to_number": False}), Step("drop_duplicates"),
        Step("fill_missing", {"column": "b", "method": "constant", "value": "?"}),
    ]
    recipe, passes, collected = Recipe("raw", steps), [], type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: passes.append(1) or collected(self))
    got = [(r["rows_before"], r["rows_after"], r["rows_affected"]) for r in recipe.ledger(df).collect()]
    monkeypatch.undo()
    assert len(passes) == 2
    assert got == [(9, 8, 1), (8, 6, 2), (6, 4, 2), (4, 4, 1), (4, 3, 1), (3, 3, 1)]
    assert recipe.apply(df).count() == 3
    empty = recipe.ledger(frame({"a": ("string", ["a"]), "b": ("string", ["b"])}, partitions=1)).collect()
    assert [(r["rows_before"], r["rows_after"]) for r in empty] == [(1, 0)] + [(0, 0)] * 5
