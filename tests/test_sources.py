import json

import pytest
from pyspark.sql import functions as F

from frames import rows
from gritsieve.functions.cells import ROW_ID
from gritsieve.plans.plan import Step
from gritsieve.plans.recipe import Recipe
from gritsieve.sources.ranking import rank_tables
from gritsieve.sources.readers import UnsupportedFile, load, with_detected_header, without_padding
from gritsieve.sources.sinks import write_clean, write_ledger


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name, sep", [("a.csv", ","), ("b.csv", ";"), ("c.tsv", "\t"), ("d.txt", "|")])
def test_delimiters(spark, tmp_path, name, sep):
    text = "\n".join(sep.join(r) for r in [[" age ", "note"], ["34", '"a, b; c"'], ["N/A", '"say ""hi"""'], ["", "  x"]])
    got = load(spark, put(tmp_path, name, text))
    assert got.df.columns == [ROW_ID, "age", "note"]
    assert rows(got.df, "age", "note") == [("34", "a, b; c"), (None, 'say "hi"'), (None, "  x")]
    assert any("age" in note for note in got.notes)


def test_row_order_across_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for f, size in enumerate([500, 5, 2_000]):
        (folder / f"part{f}.csv").write_text("v\n" + "\n".join(f"{f}-{i:05d}" for i in range(size)) + "\n")
    got = rows(load(spark, str(folder)).df, "v")
    assert len(got) == 2_505 and got == sorted(got)


def test_errors_and_notes(spark, tmp_path):
    with pytest.raises(UnsupportedFile, match="No reader"):
        load(spark, str(tmp_path / "x.docx"))
    with pytest.raises(UnsupportedFile):
        load(spark, put(tmp_path, "empty.csv", ""))
    with pytest.raises(UnsupportedFile, match="no rows"):
        load(spark, put(tmp_path, "head.csv", "a,b\n"))
    assert any("separator" in n for n in load(spark, put(tmp_path, "one.csv", "a\n1\n")).notes)


def test_json_shapes(spark, tmp_path):
    records = [{"id": 1, "who": {"name": "A", "home": {"town": "Kano"}}}, {"id": 2, "who": {"name": "B", "home": None}}]
    for name, body in {
        "lines.json": "\n".join(map(json.dumps, records)), "list.json": json.dumps(records, indent=1),
        "wrapped.json": json.dumps({"results": records, "page": 1}),
    }.items():
        got = load(spark, put(tmp_path, name, body))
        assert got.df.columns == [ROW_ID, "id", "who.home.town", "who.name"], name
        assert rows(got.df, "id", "who.home.town") == [(1, "Kano"), (2, None)]
        assert any("dotted" in n for n in got.notes)
    assert any("results" in n for n in got.notes)


def test_title_block_and_padding(frame):
    raw = frame({
        "_c0": ("string", ["Survey 2026", None, None, "id", "1", "2", None]), "_c1": ("string", [None, None, None, "age", "30", None, None]),
        "_c2": ("string", [None, "Lagos", None, "state", "Kano", "Oyo", None]), "_c3": ("string", [None] * 7),
    })
    got = with_detected_header(raw)
    assert got.df.columns == [ROW_ID, "id", "age", "state"]
    assert rows(got.df, "id", "state") == [("1", "Kano"), ("2", "Oyo")]
    assert any("3 row(s)" in n for n in got.notes) and any("empty column" in n for n in got.notes)
    assert without_padding(frame({"Unnamed: 1": ("string", ["x"])})).df.columns == [ROW_ID, "Unnamed: 1"]


def test_ranking(frame):
    data = frame({"a": ("int", list(range(50))), "b": ("string", ["x"] * 50)})
    book = frame({"code": ("string", ["q"] * 400), "meaning": ("string", ["m"] * 400)})
    ranked = [r["table"] for r in rank_tables({"Codebook ": book, "Responses": data}).collect()]
    assert ranked == ["Responses", "Codebook "]
    assert rank_tables({"Codebook ": book, "Responses": data}, choice="Codebook ").first()["table"] == "Codebook "
    with pytest.raises(KeyError):
        rank_tables({"Responses": data}, choice="Other")


def test_sinks(spark, frame, tmp_path):
    df = frame({"Q1": ("string", ["Agree", "disagree", None]), "note": ("string", ['a "b", c', " x", "line"])})
    recipe = Recipe.learn(df, [Step("order_likert", {"column": "Q1", "order": ["disagree", "agree"]}, "scale")])
    out = recipe.apply(df)
    write_clean(out, str(tmp_path / "out.csv"))
    back = load(spark, str(tmp_path / "out.csv")).df
    assert back.columns == [ROW_ID, "Q1", "note"]
    assert sorted(rows(back, "note")) == sorted([" x", 'a "b", c', "line"])
    write_clean(out, str(tmp_path / "out.parquet"), "parquet", keep_helpers=True)
    kept = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert kept.schema["Q1"].metadata["levels"] == ["disagree", "agree"] and "Q1__ord" in kept.columns
    write_ledger(recipe.ledger(df), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).select(F.first("op")).first()[0] == "order_likert"
