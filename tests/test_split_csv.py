import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from frames import rows
from gritsieve.functions.cells import ROW_ID
from gritsieve.relations import data_columns
from gritsieve.sources.readers import load, read_delimited
from gritsieve.sources.split_csv import IN, OUT, left_open, line_effects, split_states


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rng):
    return rng.choice([
        "", "plain", "with, comma", 'say ""hi""'.replace('""', '"'), "two\nlines", "a\n\n\nb", '"', '""', ',"', '",', '\n"\n', "x" * rng.randint(1, 80),
        "quote at end\"", "new,\n,line", "7", " ", '"\n",",\n"',
    ])


def written(data, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(data)
    return out.getvalue()


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_any_cells_in_any_splits(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    data = [[str(i), cell(rng), cell(rng), f"z{i}"] for i in range(400)]
    (tmp_path / "t.csv").write_bytes(written([["id", "a", "b", "end"], *data], end).encode())
    got = read_delimited(spark, str(tmp_path / "t.csv"), ",", null_tokens=[])
    whole = read_delimited(spark, str(tmp_path / "t.csv"), ",", null_tokens=[], multiline=True)
    assert got.df.columns == whole.df.columns == [ROW_ID, "id", "a", "b", "end"]
    values = [tuple(c or None for c in r) for r in rows(got.df, "id", "a", "b", "end")]
    assert values == [tuple(c or None for c in r) for r in data]
    assert values == [tuple(c or None for c in r) for r in rows(whole.df, "id", "a", "b", "end")]


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    data = [[str(i), f"line {i}\ngoes, on\n\"here\""] for i in range(500)]
    (tmp_path / "t.csv").write_text(written([["id", "text"], *data]))
    effects = line_effects(spark, str(tmp_path / "t.csv"), ",")
    assert effects.rdd.getNumPartitions() > 20
    states = split_states(effects).collect()
    assert len(states) > 20 and {r["_state"] for r in states} == {0, 1}
    assert rows(load(spark, str(tmp_path / "t.csv")).df, "id", "text") == [tuple(r) for r in data]


def test_a_cell_longer_than_splits_and_several_files(spark, tmp_path, small_splits):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    want = []
    for f in range(3):
        data = [[f"{f}-{i}", ("long\n" * 400 if i == 2 else f"a\n{i}")] for i in range(5)]
        want += data
        (folder / f"p{f}.csv").write_text(written([["id", "text"], *data]))
    assert rows(load(spark, str(folder)).df, "id", "text") == [tuple(r) for r in want]


def test_no_header_blank_lines_short_rows_and_an_open_end(spark, tmp_path, small_splits):
    text = '\n1,"a\nb",x\n\n2\n3,"c",y,more\n4,5" wide,z\n5,"never closed\nto the end'
    (tmp_path / "t.csv").write_text(text)
    got = read_delimited(spark, str(tmp_path / "t.csv"), ",", header=False)
    assert rows(got.df, *data_columns(got.df)) == [
        ("1", "a\nb", "x"), ("2", None, None), ("3", "c", "y"), ("4", '5" wide', "z"), ("5", "never closed\nto the end", None)]


def test_files_without_such_cells_stay_in_lines(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f'{i},"x ""{i}"", y"\n' for i in range(200)))
    got = load(spark, str(tmp_path / "t.csv")).df
    assert "from_csv" not in got._jdf.queryExecution().analyzed().toString() and got.rdd.getNumPartitions() > 5
    assert rows(got, "b")[7] == 'x "7", y'


def reference_open(line, sep, inside):
    """The state machine, a character at a time."""
    state, i, fresh = (2 if inside else 0), 0, True
    while i < len(line):
        c = line[i]
        if state == 2:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state, fresh = 0, False
        elif c == sep:
            fresh = True
        elif c == '"' and fresh:
            state = 2
        else:
            fresh = False
        i += 1
    return int(state == 2)


def test_effects_of_lines(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice('ab,"",') for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    got = df.select("v", left_open(F.col("v"), ",", OUT).alias("o"), left_open(F.col("v"), ",", IN).alias("i")).collect()
    for r in got:
        assert (r.o, r.i) == (reference_open(r.v, ",", False), reference_open(r.v, ",", True)), r.v
