import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import rows
from gritsieve.describe import charts
from gritsieve.describe.questions import median_level
from gritsieve.describe.roles import classify
from gritsieve.operators.cleaning import collapse_multiselect, order_likert


def by(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 10.0, None], [5.0] * 7, np.linspace(-1, 1, 101).tolist(), [0.1 * i for i in range(50)]])
def test_histogram_is_numpys(frame, values):
    got = by(charts.histogram(frame({"v": ("double", values)}), "v"), "bin")
    known = [v for v in values if v is not None]
    counts, edges = np.histogram(known, bins=min(20, max(5, len(set(known)))))
    assert [r[3] for r in got] == list(counts) and [r[1] for r in got] == pytest.approx(list(edges[:-1]))


def test_timeseries_fills_quiet_days(frame):
    at = [dt.datetime(2026, 2, 27, 10), dt.datetime(2026, 2, 27, 23), dt.datetime(2026, 3, 2), None]
    got = by(charts.timeseries(frame({"t": ("timestamp_ntz", at)}), "t"), "day")
    assert got == [(dt.date(2026, 2, 27), 2), (dt.date(2026, 2, 28), 0), (dt.date(2026, 3, 1), 0), (dt.date(2026, 3, 2), 1)]


def test_box(frame):
    v = [1.0, 2.0, 3.0, 4.0, 100.0, 7.0, None]
    df = frame({"g": ("string", ["a"] * 5 + ["b"] * 2), "v": ("double", v)})
    assert by(charts.box_by_group(df, "g", "v"), "group") == [
        ("a", 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1), ("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)
    ]


def test_shares_and_levels(frame):
    df = frame({"g": ("string", ["x", "x", "x", "y", None]), "q": ("string", ["No", "yes", "YES ", "No", "No"])})
    df = order_likert(df, "q", ["no", "yes"])
    got = by(charts.grouped_bar(df, "g", "q"), "group", "level")
    assert [(g, s, n) for g, s, n, _ in got] == [("x", "no", 1), ("x", "yes", 2), ("y", "no", 1)]
    assert [p for *_, p in got] == pytest.approx([100 / 3, 200 / 3, 100])
    bars = charts.likert_bar(order_likert(df, "q", ["no", "maybe", "yes"]), "q")
    assert by(bars, "place") == [(1, "no", 3), (2, "maybe", 0), (3, "yes", 2)]
    assert by(median_level(df, "q", "g"), "overall", "group") == [
        (False, "x", 3, 2, "yes"), (False, "y", 1, 1, "no"), (True, None, 5, 1, "no")
    ]


def test_roles_rules(frame):
    n = 40
    df = frame({
        "respondent_id": ("string", ["r"] * n), "age": ("int", list(range(n))), "coded": ("int", [i % 3 for i in range(n)]),
        "state": ("string", [f"s{i % 14}" for i in range(n)]), "note": ("string", [f"n{i % 20}" for i in range(n)]),
        "ref": ("string", [f"k{i}" for i in range(n)]), "near": ("string", [f"k{i % 37}" for i in range(n)]),
        "edge": ("string", [f"k{i % 36}" for i in range(n)]), "ok": ("boolean", [True] * n), "x_invalid": ("string", ["a"] * n),
        "when": ("date", [dt.date(2026, 1, 1)] * n), "Q1": ("string", ["no", "yes"] * 20), "Q7_Part_1": ("string", ["a"] * n),
        "Q7_Part_2": ("string", ["b"] * n),
    })
    df = collapse_multiselect(order_likert(df, "Q1", ["no", "yes"]), "Q7", ["Q7_Part_1", "Q7_Part_2"])
    role = {r["column"]: r["role"] for r in classify(df).collect()}
    assert role == {
        "respondent_id": "identifier", "age": "numeric", "state": "categorical", "note": "free_text", "ref": "identifier",
        "near": "identifier", "edge": "free_text", "ok": "flag", "x_invalid": "flag", "when": "datetime", "Q1": "ordered",
        "Q7_Part_1": "multiselect_member", "Q7_Part_2": "multiselect_member", "Q7_selected": "categorical",
    }


def test_scatter_and_missingness(frame):
    df = frame({"a": ("double", [1.0, None, 3.0, float("nan")]), "b": ("double", [1.0, 2.0, 3.0, 4.0])})
    assert sorted(map(tuple, charts.scatter(df, "a", "b").collect())) == [(1.0, 1.0), (3.0, 3.0)]
    assert by(charts.missingness(df), "column") == [("a", 50.0, True), ("b", 0.0, False)]
    assert rows(df.withColumn("x", F.lit(1)), "x") == [1] * 4


def test_infinite_values_have_bins_of_their_own(frame):
    df = frame({"v": ("double", [1.0, 2.0, float("inf"), float("-inf"), float("inf"), None, float("nan")])})
    got = by(charts.histogram(df, "v"), "bin")
    assert got[0] == (-1, float("-inf"), float("-inf"), 1) and got[-1] == (5, float("inf"), float("inf"), 2)
    assert [r[3] for r in got[1:-1]] == [1, 0, 0, 0, 1] and got[1][1] == 1.0 and got[-2][2] == 2.0


def test_every_chart_is_suggested(frame):
    n = 40
    df = frame({f"c{i}": ("string", [f"v{j % (2 + i % 4)}" for j in range(n)]) for i in range(9)} | {
        f"n{i}": ("int", [j + i for j in range(n)]) for i in range(8)})
    got = charts.suggest_charts(df).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"category_bar": 9, "histogram": 8, "box_by_group": 72, "scatter": 28}
