"""Writing the cleaned table and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.cells import ROW_ID, named
from gritsieve.relations import data_columns


def without_helpers(df: DataFrame) -> DataFrame:
    """The user's columns only: row ids and ordinals are ours."""
    return df.select(*[named(c) for c in data_columns(df)])


def write_clean(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", keep_helpers: bool = False) -> None:
    """CSV for exchange; Parquet keeps types, ordinals and levels."""
    out = df.drop(ROW_ID) if keep_helpers else without_helpers(df)
    if fmt != "csv":
        out.write.mode(mode).format(fmt).save(path)
        return
    nested = [f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    out = out.withColumns({c: F.to_json(named(c)) for c in nested}) if nested else out
    # Outer blanks are data here; by default the writer would trim them.
    out.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_ledger(ledger: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per step, in order; a ledger has a row per step of a plan."""
    ledger.orderBy("seq").coalesce(1).write.mode(mode).json(path)
