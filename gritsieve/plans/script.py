"""Export a recipe as a script that needs only pyspark.

The script carries the very source of the operators it calls, so it cannot drift from what ran.
"""

from __future__ import annotations

import inspect
import pprint

from gritsieve.functions import cells
from gritsieve.operators import cleaning
from gritsieve.plans.recipe import Recipe

HELPERS = [
    "value_columns", "tidy", "literal_like", "is_one_of", "repeats_name", "how_many", "header_copy", "all_blank", "outside", "row_key",
]


def _needed(names: list[str]) -> list[str]:
    """The operators used, and the operators those call, in the order of their module."""
    wanted = set(names)
    if "deidentify" in wanted:
        wanted.add("drop_column")
    return [n for n in vars(cleaning) if n in wanted]


def to_script(recipe: Recipe, read: str, write: str, notes: list[str] = ()) -> str:
    """`read` and `write` are pyspark expressions: one yields a DataFrame, the other ends with it as `df`."""
    parts = [
        '"""Cleaning script. Reproduces the recorded steps from the raw input; needs only pyspark."""',
        "import re",
        inspect.getsource(cells).split('"""', 2)[2].strip(),
        "from pyspark.sql import SparkSession",
        f"BROADCAST_KEYS = {cleaning.BROADCAST_KEYS}\nINLINE_KEYS = {cleaning.INLINE_KEYS}",
        *[inspect.getsource(getattr(cleaning, n)).strip() for n in HELPERS + _needed([s.op for s in recipe.steps])],
        f"# Source: {recipe.source}",
        *[f"# {note}" for note in notes],
        "spark = SparkSession.builder.getOrCreate()",
        f"df = {read}",
    ]
    for i, step in enumerate(recipe.steps, 1):
        reason = " ".join(step.rationale.split())
        parts.append(f"# {i}. {step.op}{': ' + reason if reason else ''}\ndf = {step.op}(df, **{pprint.pformat(step.params)})")
    parts.append(write)
    return "\n\n\n".join(parts) + "\n"
