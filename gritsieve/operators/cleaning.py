"""The nineteen cleaning operators, each `(DataFrame, **params) -> DataFrame`.

Every function uses only pyspark and `functions.cells`, so an exported script can carry its source.
"""

import re

from pyspark.sql import functions as F

from gritsieve.functions.cells import (
    ORDINAL, ROW_ID, hash_prefix, named, norm, number, parsed_date, present, stripped,
)

BROADCAST_KEYS = 1_000_000
INLINE_KEYS = 200


def value_columns(df):
    names = set(df.columns)
    return [
        c for c in df.columns
        if c != ROW_ID and not (c.endswith(ORDINAL) and c[: -len(ORDINAL)] in names)
    ]


def tidy(df, column):
    return present(named(column), df.schema[column].dataType)


def literal_like(df, column, value):
    """A literal comparable with the column: text stays text, numbers keep their integer precision."""
    if df.schema[column].dataType.typeName() in ("string", "varchar", "char"):
        return F.lit(value if isinstance(value, str) else str(value))
    if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value.strip()):
        return F.lit(int(value))
    return F.lit(float(value) if isinstance(value, str) else value)


def is_one_of(df, column, values):
    return F.coalesce(tidy(df, column).isin([literal_like(df, column, v) for v in values]), F.lit(False))


def repeats_name(df, column):
    """True for a cell that is its own column's name; a cheap test spares most cells the full comparison."""
    name = column.strip().lower()
    text = named(column).cast("string")
    if df.schema[column].dataType.typeName() in ("string", "varchar", "char"):
        return F.coalesce(F.lower(text).contains(F.lit(name)) & (norm(text) == F.lit(name)), F.lit(False))
    # Numbers and dates never spell a name that starts with a letter.
    return F.lit(False) if name[:1].isalpha() and name not in ("true", "false") else F.coalesce(norm(text) == name, F.lit(False))


def header_copy(df):
    """True for a row in which at least two cells and half of all cells repeat their column's name."""
    names = value_columns(df)
    return how_many([repeats_name(df, c) for c in names]) >= max(2, len(names) * 0.5)


def how_many(tests):
    """How many of these tests hold for a row. Flat, so that a table may have thousands of columns."""
    return F.size(F.filter(F.array(*tests), lambda hit: hit)) if tests else F.lit(0)


def all_blank(df):
    return F.coalesce(*[tidy(df, c).cast("string") for c in value_columns(df)]).isNull()


def outside(df, column, lower, upper):
    value = tidy(df, column)
    return F.coalesce((value < F.lit(lower)) | (value > F.lit(upper)), F.lit(False))


# Structure


def promote_header_row(df, drop_rows=1):
    top = df.select(ROW_ID).orderBy(ROW_ID).limit(drop_rows)
    side = F.broadcast(top) if drop_rows <= BROADCAST_KEYS else top
    return df.join(side, ROW_ID, "left_anti").select(*[named(c) for c in df.columns])


def drop_repeated_header_rows(df):
    return df.filter(~header_copy(df))


def drop_empty_rows(df):
    return df.filter(~all_blank(df))


def drop_column(df, column):
    if column not in df.columns:
        raise KeyError(column)
    return df.drop(named(column))


def rename_column(df, column, new_name):
    if column not in df.columns:
        raise KeyError(column)
    ordinals = {column: new_name, column + ORDINAL: new_name + ORDINAL}
    return df.select(*[named(c).alias(ordinals.get(c, c), metadata=df.schema[c].metadata) for c in df.columns])


def drop_constant_columns(df, columns):
    return df.select(*[named(c) for c in df.columns if c not in set(columns)])


def collapse_multiselect(df, stem, members):
    kept = [m for m in members if m in df.columns]
    ticked = how_many([tidy(df, m).isNotNull() for m in kept])
    chosen = F.concat_ws(", ", *[tidy(df, m).cast("string") for m in kept])
    return df.withColumns({stem + "_count": ticked, stem + "_selected": chosen})


# Disguised missing values


def recode_sentinel_missing(df, column, values, to_number=False):
    kept = F.when(~is_one_of(df, column, values), tidy(df, column))
    return df.withColumn(column, number(kept) if to_number else kept)


# Types


def order_likert(df, column, order, keep_unmatched=False):
    """The label in its canonical spelling, and its 1-based place in the scale beside it.

    What is no level becomes blank, or with `keep_unmatched` stays as it is, without a place.
    """
    text = norm(named(column))
    label = F.coalesce(*[F.when(text == level.strip().lower(), F.lit(level)) for level in order])
    if keep_unmatched:
        label = F.coalesce(label, named(column).cast("string"))
    place = F.coalesce(*[F.when(text == level.strip().lower(), F.lit(i + 1)) for i, level in enumerate(order)])
    return df.select(
        *[
            label.alias(column, metadata={"levels": list(order)}) if c == column else named(c)
            for c in df.columns if c != column + ORDINAL
        ],
        place.alias(column + ORDINAL),
    )


def coerce_numeric(df, column):
    if df.schema[column].dataType.typeName() in ("string", "varchar", "char"):
        return df.withColumn(column, number(named(column)))
    return df.withColumn(column, tidy(df, column))


def coerce_datetime(df, column, dayfirst=False):
    if df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return df
    return df.withColumn(column, parsed_date(named(column), dayfirst))


# Standard spellings


def strip_whitespace(df, column):
    return df.withColumn(column, stripped(named(column)))


def map_categories(df, column, mapping):
    """A few spellings become one CASE; a long dictionary becomes a join with its own table."""
    text = named(column).cast("string")
    if len(mapping) <= INLINE_KEYS:
        merged = F.coalesce(*[F.when(text == str(old), F.lit(new)) for old, new in mapping.items()], named(column))
        return df.withColumn(column, merged) if mapping else df
    pairs = df.sparkSession.createDataFrame(
        [(str(old), str(new)) for old, new in mapping.items()], "_old string, _new string"
    )
    side = F.broadcast(pairs) if len(mapping) <= BROADCAST_KEYS else pairs
    joined = df.join(side, text == F.col("_old"), "left")
    return joined.select(
        *[F.coalesce(F.col("_new"), named(c)).alias(c) if c == column else named(c) for c in df.columns]
    )


# Duplicates


def row_key(df, column):
    """What a cell is compared by: NaN is blank, minus zero is zero, a map is its sorted entries."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("double", "float"):
        value = tidy(df, column)
        return F.when(value == 0, F.lit(0).cast(kind)).otherwise(value)
    return F.array_sort(F.map_entries(named(column))) if kind == "map" else named(column)


def drop_duplicates(df):
    """One row of every set of equal rows, by `row_key`: the first by row id where there is one.

    NaN comes out blank, as it counts as. Ordinals follow from their labels; grouping by both keeps them without
    another aggregate.
    """
    maps = [c for c in df.columns if df.schema[c].dataType.typeName() == "map"]
    keys = [c for c in df.columns if c != ROW_ID and c not in maps]
    carried = [F.min(named(ROW_ID)).alias(ROW_ID)] if ROW_ID in df.columns else []
    carried += [F.any_value(named(c)).alias(c) for c in maps]
    compared = [row_key(df, c).alias(c) for c in keys]
    if not carried:
        return df.select(*compared).distinct().select(*[named(c) for c in df.columns])
    kept = df.groupBy(*compared, *[row_key(df, c) for c in maps]).agg(*carried)
    return kept.select(*[named(c) for c in df.columns])


# Missing values, outliers, flags, privacy


def fill_missing(df, column, method="constant", value=None):
    """`value` is the filler; the recipe works it out beforehand for median, mean and mode."""
    if method not in ("median", "mean", "mode", "constant"):
        raise ValueError(f"Unknown fill method: {method}")
    if value is None:
        return df
    kind = df.schema[column].dataType
    if isinstance(value, float) and kind.typeName() in ("byte", "short", "integer", "long") and value % 1:
        kind = "double"
    return df.withColumn(column, F.coalesce(tidy(df, column).cast(kind), F.lit(value).cast(kind)))


def clip_outliers(df, column, lower, upper):
    value = tidy(df, column)
    if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        lower, upper = (int(b) if float(b).is_integer() else b for b in (lower, upper))
    return df.withColumn(
        column,
        F.when(value < F.lit(lower), F.lit(lower)).when(value > F.lit(upper), F.lit(upper)).otherwise(value),
    )


def flag_out_of_range(df, column, lower, upper):
    return df.withColumn(column + "_out_of_range", outside(df, column, lower, upper))


def flag_date_order(df, start_column, end_column):
    early = F.coalesce(named(end_column) < named(start_column), F.lit(False))
    return df.withColumn(end_column + "_before_" + start_column, early)


def deidentify(df, column, method="hash"):
    if method == "drop":
        return drop_column(df, column)
    return df.withColumn(column, hash_prefix(tidy(df, column)))
