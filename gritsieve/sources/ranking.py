"""Which of several tables is the data rather than the paperwork."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gritsieve.constants import PAPERWORK_NAMES
from gritsieve.relations import cell, data_columns


def rank_tables(tables: dict[str, DataFrame], choice: str | None = None) -> DataFrame:
    """One row per table with its score, best first; an explicit choice goes on top."""
    if choice is not None and choice not in tables:
        raise KeyError(f"No table named {choice!r}. Found: {sorted(tables)}")

    def measured(name: str, df: DataFrame) -> DataFrame:
        columns = data_columns(df)
        filled = [F.count(cell(df, c)) for c in columns]
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*filled).alias("filled"))
        return counts.select(
            "n_rows",
            F.size(F.filter("filled", lambda n: n > 0)).alias("n_cols"),
            F.aggregate("filled", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("filled_cells"),
        ).select(F.lit(name).alias("table"), F.lit(len(columns)).alias("width"), "*")

    sizes = reduce(DataFrame.unionByName, [measured(n, df) for n, df in tables.items()])
    paperwork = F.lower(F.trim("table")).isin(PAPERWORK_NAMES)
    score = (
        F.col("filled_cells") * (1 + 0.1 * F.least(F.col("width"), F.lit(40)))
        * F.when(paperwork, 0.01).otherwise(1.0)
        * F.when(F.col("n_rows") < 3, 0.1).otherwise(1.0)
    )
    chosen = F.col("table") == F.lit(choice) if choice else F.lit(False)
    return sizes.select("table", "n_rows", "n_cols", "filled_cells", score.alias("score")).orderBy(
        chosen.desc(), F.desc("score"), "table"
    )
