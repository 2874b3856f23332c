"""Reading results in tests."""

from gritsieve.functions.cells import ROW_ID


def rows(df, *columns):
    """Values in row order."""
    out = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in out.collect()]
