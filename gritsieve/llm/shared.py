"""Folders that driver and executors share, tables that cut lineage, and pieces of text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without these ASCII spaces; Java and Python patterns agree on it.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local session without one (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


_WATCHING: list[list[str]] = []


@contextmanager
def watched() -> Iterator[list[str]]:
    """The paths of all tables stored inside the block."""
    paths: list[str] = []
    _WATCHING.append(paths)
    try:
        yield paths
    finally:
        _WATCHING.remove(paths)


def stored(df: DataFrame, label: str, **options: int) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: it is computed once, and a lost executor costs nothing.

    options: of Spark's writer."""
    path = new_path(df.sparkSession, label)
    for paths in _WATCHING:
        paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(session: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no later plan reads; one that is gone already is no error."""
    for name in paths:
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    delete(df.sparkSession, sorted({f.rpartition("/")[0] for f in df.inputFiles()}))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns computed once per row. A filter on them stays above: it cannot be rewritten over their sources,
    as the optimizer does with a projection, which would compute costly expressions once per mention."""
    values = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(values)))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` bears it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_parts(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A UTF-8 text in parts of about `size` bytes, cut at ASCII spaces only, so that no word is cut."""
    space = re.compile(rb"[\x20\x09-\x0D]")
    start = 0
    while len(data) - start > size:
        found = space.search(data, start + size)
        if not found:
            break
        yield data[start : found.start()]
        start = found.end()
    yield data[start:]
