import json
import re

import pytest
from pyspark.sql import functions as F

from gritsieve.operators import detectors as find
from gritsieve.operators import profile as prof
from gritsieve.operators.evidence import Evidence, duplicate_rows
from gritsieve.plans import plan as planning
from gritsieve.plans.recipe import Recipe

SEXES = {"male": 40, "F": 33, "Boy": 21, "girl": 20, "1": 12, "2": 11, "X": 5}
INSURED = {"y": 50, "NO": 41, "True": 17, "false": 16, "1.0": 9, "0": 8, "maybe": 4}


def spread(counts):
    return [v for v, n in counts.items() for _ in range(n)]


def found(detect, df):
    return [r.asDict() | {"p": json.loads(r["params"] or "{}")} for r in detect(Evidence(df)).collect()]


@pytest.mark.parametrize("name, counts, answers, alone", [
    ("sex at birth", SEXES, {"1": "Male", "2": "Female", "Boy": "Male", "F": "Female"}, "X"),
    ("insured", INSURED, {"1.0": "Yes", "0": "No", "True": "Yes", "NO": "No"}, "maybe"),
])
def test_synonyms(frame, name, counts, answers, alone):
    [f] = found(find.value_synonyms, frame({name: ("string", spread(counts))}))
    mapping = f["p"]["mapping"]
    assert answers.items() <= mapping.items() and alone not in mapping
    assert f["confidence"] == 0.93 and f["op"] == "map_categories"


def test_synonyms_leave_consistent_numeric_and_prose_alone(frame):
    df = frame({
        "Smoker?": ("string", ["Yes", "No"] * 40), "prior_admissions": ("int", [1, 2] * 40),
        "notes": ("string", [f"comment number {i}" for i in range(80)]),
    })
    assert found(find.value_synonyms, df) == []


def test_missing_codes(frame):
    df = frame({
        "Smoker?": ("string", ["Yes"] * 40 + ["No"] * 40 + ["?"] * 8 + [" N/A "] * 2),
        "Age": ("bigint", [34, 41, -9223372036854775808, 55, 29, 60, 61, 62, 63] * 10),
        "score": ("int", [99] * 85 + [1, 2, 3, 4, 5]),
        "weight": ("string", ["70", "999", "65.5", "-99"] * 22 + ["80"] * 2),
    })
    got = {(f["column"], f["confidence"]): f for f in found(find.sentinel_missing, df)}
    assert set(got) == {("Smoker?", 0.95), ("Age", 0.99), ("weight", 0.90), ("weight", 0.95)}
    assert got["Smoker?", 0.95]["p"]["values"] == [" N/A ", "?"] and got["Smoker?", 0.95]["n_affected"] == 10
    assert got["Age", 0.99]["p"]["values"] == ["-9223372036854775808"]
    assert got["weight", 0.95]["p"]["values"] == ["-99"] and got["weight", 0.90]["p"]["values"] == ["999"]


def test_doubtful_codes_stay_when_sure_ones_go(frame):
    """Ages of 77 and 88 are real here; only 999 is applied unattended."""
    df = frame({"Age": ("int", [999] * 20 + [77] * 30 + [88] * 30 + [40, 41, 42, 43, 44, 45, 46] * 20)})
    plan = planning.build_plan(find.scan(df))
    sure = planning.steps_of(planning.auto_apply(plan))
    assert [s.params["values"] for s in sure if s.op == "recode_sentinel_missing"] == [["999"]]
    out = Recipe.learn(df, sure).apply(df)
    assert out.where("Age in (77, 88)").count() == 2 and out.where("Age = 999").count() == 0
    everything = planning.steps_of(planning.auto_apply(plan, 0.5))
    assert [s.params["values"] for s in everything if s.op == "recode_sentinel_missing"] == [["77", "88", "999"]]


def test_missing_codes_in_a_column_of_many_values(frame):
    """A column too varied for value counts still gives up its codes, and only those."""
    df = frame({"v": ("string", [f"name {i}" for i in range(900)] + ["unknown"] * 3 + [" Refused"])})
    got = {f["confidence"]: (f["p"]["values"], f["n_affected"]) for f in found(find.sentinel_missing, df)}
    assert got == {0.95: ([" Refused"], 1), 0.80: (["unknown"], 3)}
    assert found(find.case_variants, df) == []


def test_scales(frame):
    df = frame({
        "Q1": ("string", ["Agree", "Disagree", " neutral "] * 8),
        "Q2": ("string", ["Often", "Never", "Sometimes", "what"] * 6),
        "Q3": ("string", ["red", "green", "blue"] * 8),
    })
    got = {f["column"]: f for f in found(find.likert_scale, df)}
    assert got["Q1"]["p"]["order"] == ["disagree", "neutral", "agree"] and got["Q1"]["confidence"] == 0.95
    assert got["Q2"]["confidence"] == 0.75 and "Q3" not in got


def test_case_variants_take_the_commonest_then_the_first(frame):
    df = frame({
        "state": ("string", ["lagos", "Lagos", "Lagos", " Lagos", "Kano", "Oyo"]),
        "town": ("string", ["b ", "b", "a", "A", "c", "c"]),
    })
    got = {f["column"]: f["p"]["mapping"] for f in found(find.case_variants, df)}
    assert got == {"state": {"lagos": "Lagos", " Lagos": "Lagos"}, "town": {"b": "b ", "A": "a"}}


def test_header_copies(frame):
    columns = {"Gender": ("string", ["Male", "Female"] * 20 + ["Gender"]), "Age": ("string", ["30", "40"] * 20 + [" AGE"])}
    [f] = found(find.repeated_header_row, frame(columns))
    assert f["n_affected"] == 1
    clean = {"Gender": ("string", ["Male"] * 3), "Age": ("string", ["30", "31", "32"])}
    assert found(find.repeated_header_row, frame(clean)) == []


def test_dates_and_numbers(frame):
    df = frame({
        "Age": ("string", [str(18 + i % 70) for i in range(120)]),
        "Admit Date": ("string", ["2026-03-01", "01/03/2026", "2026-02-11", "11-02-2026"] * 30),
        "bp": ("string", [f"{100 + i}/{60 + i}" for i in range(120)]),
        "coded": ("string", ["1", "2"] * 60),
        "mixed": ("string", ["12"] * 50 + ["13"] * 30 + ["14"] * 20 + ["many"] * 20),
    })
    assert [f["column"] for f in found(find.date_like, df)] == ["Admit Date"]
    got = {f["column"]: f["confidence"] for f in found(find.numeric_like, df)}
    assert got == {"Age": 0.95, "mixed": 0.83}


def test_ranges(frame):
    df = frame({
        "age": ("int", [30, 999, -1]), "heart_rate": ("double", [70.0, 180.0, None]), "bmi": ("double", [20.0, 21.0, 22.0]),
        "Age text": ("string", ["999", "1", "2"]),
    })
    got = {f["column"]: (f["n_affected"], f["p"]["lower"], f["p"]["upper"]) for f in found(find.implausible_range, df)}
    assert got == {"age": (2, 0.0, 120.0), "heart_rate": (1, 0.0, 100.0)}


def test_constants_and_blanks(frame):
    df = frame({
        "consent": ("string", ["Yes"] * 20), "ticked": ("string", ["Yes"] * 10 + [None] * 10),
        "empty": ("string", [None] * 20), "rare": ("string", ["x"] + [None] * 19), "many": ("string", ["x"] * 4 + [None] * 16),
        "few": ("string", ["x"] * 12 + [None] * 8),
    })
    [f] = found(find.constant_columns, df)
    assert f["p"]["columns"] == ["consent", "empty"]
    blank = {f["column"]: f["confidence"] for f in found(find.structural_missing, df)}
    assert blank == {"ticked": 0.55, "empty": 0.90, "rare": 0.90, "many": 0.75}


def test_names(frame):
    names = [
        "respondent_id", "respondent_name", "emailAddress", "national_id", "patient_id", "hospital_no", "case_no",
        "participant_id", "other_text", "e_mail", "free_text_comment", "age", "EncounterID",
    ]
    got = {f["column"]: f for f in found(find.pii, frame({n: ("string", ["x"]) for n in names}))}
    assert set(names) - set(got) == {"age", "EncounterID"}
    assert "record id" in got["respondent_id"]["detail"] and got["respondent_name"]["confidence"] == 0.80
    assert got["free_text_comment"]["op"] is None and got["free_text_comment"]["confidence"] == 0.50


def test_multiselect_names():
    names = ["Q7_Part_1", "Q7_Part_2", "Q7_Part_10", "Q8a_1", "Q8a_2", "Q8a_3", "g/a", "g/b", "g/c", "r___1", "r___2", "r___3", "Q9_1"]
    assert find.multiselect_groups(names) == {
        "Q7": ["Q7_Part_1", "Q7_Part_10", "Q7_Part_2"], "Q8a": ["Q8a_1", "Q8a_2", "Q8a_3"],
        "g": ["g/a", "g/b", "g/c"], "r": ["r___1", "r___2", "r___3"],
    }


def test_question_text_stops_the_scan(frame):
    df = frame({
        "Q1": ("string", ["What is your age in completed years, please?", "34", "21"]),
        "Q2": ("string", ["Which state do you currently reside in today?", "Lagos", "Kano"]),
    })
    [f] = find.scan(df).collect()
    assert f["kind"] == "two_row_header" and f["confidence"] == pytest.approx(0.97)


def test_duplicates_tell_blanks_apart(frame):
    df = frame({"a": ("string", ["x", None, "x", None, "x:1", ""]), "b": ("string", [None, "x", None, "x", "", "x:1"])})
    assert duplicate_rows(df).first()["n_duplicates"] == 2


def test_scan_of_awkward_tables(frame, spark):
    assert find.scan(spark.createDataFrame([], "a string, b int")).count() == 0
    odd = spark.sql("SELECT array(1, 2) AS `li.st`, map('a', 1) AS m, struct(1 AS x) AS s, true AS f, 'N/A' AS `Bill (GHS)`")
    assert {r["kind"] for r in find.scan(odd.union(odd)).collect()} == {"duplicate_rows", "constant_columns"}
    assert prof.profile(odd).count() == 5


def test_scores(frame):
    good = frame({"a": ("int", list(range(100))), "b": ("string", [f"v{i % 5}" for i in range(100)])})
    assert prof.quality_score(good).first()["score"] >= 95
    empty = frame({"a": ("int", [])})
    assert prof.quality_score(empty).first()["score"] == 0


def test_profile_counts_and_samples(frame):
    long = "x" * 500
    df = frame({
        "t": ("string", [long + "a", long + "b", long + "a", None, "=c", "#d"]), "n": ("double", [1.0, float("nan"), 1.0, None, 2.0, 3.0]),
    })
    got = {r["column"]: r for r in prof.profile(df).collect()}
    assert got["t"]["n_unique"] == 4 and got["t"]["sample"] == [long + "a", long + "b", "=c", "#d"]
    assert (got["n"]["n_missing"], got["n"]["n_unique"], got["n"]["n_unique_with_na"]) == (2, 3, 4)


def test_many_spellings_of_few_answers(spark):
    """Twenty thousand spellings of four answers: found by normal form, and no task holds a column's spellings."""
    blank = F.repeat(F.lit(" "), (F.col("id") % 5000).cast("int"))
    answer = F.get(F.array(F.lit("yes"), F.lit("no"), F.lit("Y"), F.lit("n")), (F.col("id") % 4).cast("int"))
    df = spark.range(40_000).select(F.concat(answer, blank).alias("consent"), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3).cast("int")).alias("k"))
    ev = Evidence(df)
    try:
        assert ev.sizes()["consent"] == (5000, 4) and ev.sizes()["k"] == (3, 3)
        (row,) = find.value_synonyms(ev).collect()
        assert row["column"] == "consent" and row["n_affected"] == 40_000 and len(json.loads(row["params"])["mapping"]) == 5000
        assert find.case_variants(ev).collect() == []
        exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", ev.counts._jdf.queryExecution().executedPlan().toString())
        assert exchanges and all("value" in keys for keys in exchanges)
    finally:
        ev.close()


def test_header_copies_are_counted_without_the_cells(frame, monkeypatch):
    df = frame({"age": ("string", ["3", " Age", None, "age"]), "sex": ("string", ["m", "SEX", "sex", "f"])})
    monkeypatch.setattr(Evidence, "read_cells", lambda ev: pytest.fail("reads every cell"))
    assert [f["n_affected"] for f in found(find.repeated_header_row, df)] == [1]


def test_texts_are_judged_once_a_value(frame, monkeypatch):
    """Whether by value or by cell, the measures are the same."""
    from gritsieve.operators import evidence

    df = frame({
        "day": ("string", [f"{i % 28 + 1:02d}/0{i % 9 + 1}/2020" for i in range(1000)]),
        "kind": ("string", [["a", " A", "999", "?", None][i % 5] for i in range(1000)]),
        "one": ("string", [f"word {i}" if i % 4 else f"{1000 + i}-01-02" for i in range(1000)]),
        "age": ("int", [999 if i % 10 == 0 else i for i in range(1000)]), "ok": ("boolean", [i % 2 == 0 for i in range(1000)]),
    })
    ev = Evidence(df).with_dates()
    assert ev.read_texts(ev.values, ev._repeated).count() == df.select("day").distinct().count() + 4 + 1000
    got, counts = ev.rows, sorted(map(str, ev.counts.collect()))
    later = Evidence(df)
    assert later.rows[0]["shaped"] == 0 and later.with_dates().rows == got
    monkeypatch.setattr(evidence, "REPEATED", 0)
    by_cell = Evidence(df).with_dates()
    assert by_cell.rows == got and sorted(map(str, by_cell.counts.collect())) == counts
    assert {c: (r["numbers"], r["codes"], r["dated"]) for c, r in zip(ev.columns, got)} == {
        "day": (0, 0, 1000), "kind": (200, 400, 0), "one": (0, 0, 250), "age": (0, 105, 0), "ok": (0, 0, 0)}


def test_a_table_in_one_part_is_spread_over_the_cores(spark):
    from gritsieve.relations import spread as dealt

    out = dealt(spark.range(0, 1000, 1, 1))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.distinct().count() == 1000 and dealt(out) is out
