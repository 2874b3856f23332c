"""The closed set of operators a plan or recipe may name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.constants import STAGES
from gritsieve.functions.cells import named, norm, number, parsed_date, stripped
from gritsieve.operators import cleaning as ops
from gritsieve.relations import is_text, local_relation

STAGE_LABEL = {number_: label for number_, _, label, _ in STAGES}


@dataclass(frozen=True)
class Operation:
    """`touched` marks the rows an op changes, as a boolean over the op's input; None means all rows. `drops` marks the rows
    it drops, where a row alone decides that."""

    name: str
    stage: int
    run: Callable[..., DataFrame]
    doc: str
    params: dict[str, str] = field(default_factory=dict)
    touched: Callable[..., Column] | None = None
    lost: Callable[..., Column] | None = None
    drops_rows: bool = False
    drops: Callable[..., Column] | None = None
    row_local: bool = True


def _parsed(df: DataFrame, column: str, **_) -> Column:
    return (number(named(column)) if is_text(df.schema[column]) else ops.tidy(df, column)).isNotNull()


def _dated(df: DataFrame, column: str, dayfirst: bool = False, **_) -> Column:
    return (parsed_date(named(column), dayfirst) if is_text(df.schema[column]) else named(column)).isNotNull()


def _present(df: DataFrame, column: str, **_) -> Column:
    return ops.tidy(df, column).isNotNull()


def _in_scale(df: DataFrame, column: str, order: list, **_) -> Column:
    return F.coalesce(norm(named(column)).isin([str(level).strip().lower() for level in order]), F.lit(False))


def _lost(kept: Callable[..., Column]) -> Callable[..., Column]:
    return lambda df, column, **params: _present(df, column) & ~kept(df, column, **params)


def _nothing(df: DataFrame, **_) -> Column:
    return F.lit(False)


OPERATIONS: dict[str, Operation] = {
    op.name: op
    for op in [
        Operation(
            "promote_header_row", 1, ops.promote_header_row, "Drop question-text rows above the data.",
            {"drop_rows": "int"}, drops_rows=True, row_local=False,
        ),
        Operation(
            "drop_repeated_header_rows", 1, ops.drop_repeated_header_rows, "Remove copies of the header line.",
            drops_rows=True, drops=ops.header_copy,
        ),
        Operation(
            "drop_empty_rows", 1, ops.drop_empty_rows, "Remove rows with every field blank.", drops_rows=True,
            drops=ops.all_blank,
        ),
        Operation("drop_column", 1, ops.drop_column, "Delete a column.", {"column": "str"}),
        Operation(
            "rename_column", 1, ops.rename_column, "Rename a column.", {"column": "str", "new_name": "str"}, _nothing
        ),
        Operation(
            "drop_constant_columns", 1, ops.drop_constant_columns, "Remove columns with one value in every row.",
            {"columns": "list"},
        ),
        Operation(
            "collapse_multiselect", 1, ops.collapse_multiselect, "Add a count and a joined list for a question.",
            {"stem": "str", "members": "list"},
        ),
        Operation(
            "recode_sentinel_missing", 2, ops.recode_sentinel_missing, "Turn missing-data codes into blanks.",
            {"column": "str", "values": "list", "to_number": "bool"},
            lambda df, column, values, **_: ops.is_one_of(df, column, values),
        ),
        Operation(
            "order_likert", 3, ops.order_likert, "Give a scale its order back.",
            {"column": "str", "order": "list"}, _in_scale, _lost(_in_scale),
        ),
        Operation(
            "coerce_numeric", 3, ops.coerce_numeric, "Text to numbers; the rest becomes blank.",
            {"column": "str"}, _parsed, _lost(_parsed),
        ),
        Operation(
            "coerce_datetime", 3, ops.coerce_datetime, "Text to timestamps; the rest becomes blank.",
            {"column": "str", "dayfirst": "bool"}, _dated, _lost(_dated),
        ),
        Operation(
            "strip_whitespace", 4, ops.strip_whitespace, "Trim both ends of a text column.", {"column": "str"},
            lambda df, column, **_: F.coalesce(
                stripped(named(column)) != named(column).cast("string"), F.lit(False)
            ),
        ),
        Operation(
            "map_categories", 4, ops.map_categories, "Merge spellings into one label.",
            {"column": "str", "mapping": "dict"},
            lambda df, column, mapping, **_: F.coalesce(
                named(column).cast("string").isin([str(k) for k in mapping]), F.lit(False)
            ),
        ),
        Operation(
            "drop_duplicates", 5, ops.drop_duplicates, "Remove exactly repeated rows.",
            drops_rows=True, row_local=False,
        ),
        Operation(
            "fill_missing", 6, ops.fill_missing, "Fill blanks; never on skipped questions.",
            {"column": "str", "method": "str", "value": "any"},
            lambda df, column, **_: ops.tidy(df, column).isNull(),
        ),
        Operation(
            "clip_outliers", 7, ops.clip_outliers, "Cap values into a range.",
            {"column": "str", "lower": "float", "upper": "float"},
            lambda df, column, lower, upper, **_: ops.outside(df, column, lower, upper),
        ),
        Operation(
            "flag_out_of_range", 8, ops.flag_out_of_range, "Mark values outside a range.",
            {"column": "str", "lower": "float", "upper": "float"},
            lambda df, column, lower, upper, **_: ops.outside(df, column, lower, upper),
        ),
        Operation(
            "flag_date_order", 8, ops.flag_date_order, "Mark rows that end before they start.",
            {"start_column": "str", "end_column": "str"},
            lambda df, start_column, end_column, **_: F.coalesce(
                named(end_column) < named(start_column), F.lit(False)
            ),
        ),
        Operation(
            "deidentify", 9, ops.deidentify, "Hash or drop an identifying column.",
            {"column": "str", "method": "str"},
            lambda df, column, method="hash", **_: F.lit(True) if method == "drop" else _present(df, column),
        ),
    ]
}


def stage_of(name: str) -> int:
    return OPERATIONS[name].stage


def stage_dimension(spark) -> DataFrame:
    rows = [dict(zip(("stage", "name", "label", "why"), row)) for row in STAGES]
    return local_relation(spark, rows, "stage int, name string, label string, why string")


def operation_dimension(spark) -> DataFrame:
    rows = [{"op": op.name, "stage": op.stage, "stage_label": STAGE_LABEL[op.stage]} for op in OPERATIONS.values()]
    return local_relation(spark, rows, "op string, stage int, stage_label string")
