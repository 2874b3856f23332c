"""SimHash near-duplicates through an index on the places of bytes, with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.components import components
from gritsieve.llm.shared import free_name, stored, text_parts

#: Production parameters. Fingerprints have eight bytes; at three differing bits at least five bytes agree in place.
SHINGLE = 3
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
#: Five of eight places hold three places of one half, so a pair agrees on one of these eight triples.
TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: Fingerprints of one index entry that meet in one group at most twice over; larger entries are dealt in blocks.
BLOCK = 2048


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text: a bit is set if over half the shingle hashes have it; 0 without words."""
    counts, total, carried = np.zeros(64, dtype=np.int64), 0, []
    hash64 = xxhash.xxh64_intdigest

    def tally(shingles: list[bytes]) -> None:
        hashes = np.array([hash64(s, 42) for s in shingles], dtype="<u8")
        counts[:] += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)

    for part in text_parts(data or b""):
        # bytes.split and bytes.lower know ASCII only, as the definition asks.
        ws = carried + part.lower().split()
        for at in range(0, len(ws) - shingle + 1, 1 << 16):
            run = ws[at : at + (1 << 16) + shingle - 1]
            shingles = [b" ".join(s) for s in zip(*(run[i:] for i in range(shingle)))]
            tally(shingles)
            total += len(shingles)
        carried = ws[-(shingle - 1):] if shingle > 1 else []
    if not total and carried:
        tally([b" ".join(carried)])
        total = 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp: the fingerprint as a signed long) for every row."""

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch["t"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": np.array(values, dtype="<u8").view("<i8"),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("t"))
    return rows.mapInPandas(prints, f"doc_id {kind}, text_hash bigint, fp bigint")


def _forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is connected among these fingerprints: one fewer than the members of a component."""
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _linked(left, one)
            for other in left[near]:
                yield int(one), int(other)
            queue.extend(left[near])
            left = left[~near]


def _linked(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Count filter, then check: five bytes or more agree in place, and at most three bits differ."""
    differing = a ^ b
    tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= LEAST_BYTES
    out[out] = np.bitwise_count(differing[out]) <= MOST_BITS
    return out


def _links_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within runs of equal (key, lo, hi) of a sorted partition; a run may go on in the next batch."""
    rest = None

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame.groupby(["key", "lo", "hi"], sort=False).ngroup().to_numpy()
        fps = frame["fp"].to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(starts, append=len(group))
        small = np.repeat(sizes <= 4, sizes)
        a, b = [], []
        for step in range(1, 4):
            together = (group[step:] == group[:-step]) & small[step:]
            x, y = fps[step:][together], fps[:-step][together]
            near = _linked(x, y)
            a.append(x[near])
            b.append(y[near])
        found = [p for at, n in zip(starts[sizes > 4], sizes[sizes > 4]) for p in _forest(np.unique(fps[at : at + n]))]
        a.append(np.array([p[0] for p in found], dtype=np.uint64))
        b.append(np.array([p[1] for p in found], dtype=np.uint64))
        out = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
        return out.drop_duplicates()

    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = frame.iloc[-1]
        same = (frame["key"] == last["key"]) & (frame["lo"] == last["lo"]) & (frame["hi"] == last["hi"])
        rest = frame[same].reset_index(drop=True)
        done = frame[~same].reset_index(drop=True)
        if len(done):
            yield links(done)
    if rest is not None and len(rest) > 1:
        yield links(rest)


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (fp) to connect all that are connected.

    The index has eight entries per fingerprint: the bytes at three places of one half. Entries with one member are
    dropped. An entry with more than `block` members is dealt in blocks by hash, and every two of its blocks meet in
    one group of about twice that size; no group yields more links than it has members.
    """
    byte = lambda p: F.shiftright(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
    entry = [
        F.lit(n << 24).cast("long") + byte(i) + F.shiftleft(byte(j), 8) + F.shiftleft(byte(k), 16)
        for n, (i, j, k) in enumerate(TRIPLES)
    ]
    index = fps.select("fp", F.explode(F.array(*entry)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = (
        index.join(sizes, "key")
        .select("key", "fp", blocks.alias("n"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    met = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return met.mapInPandas(_links_of, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint; and for each distinct fingerprint its component, and the group's first row.

    First is the smallest (id is null, id, hash of text), so null ids come last.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = stored(prints.groupBy("fp").agg(F.min(rank).alias("first")), "classes")
    groups = components(fingerprint_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    known = stored(classes.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "groups")
    return prints, known


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; documents whose fingerprints differ in three bits or fewer link.

    component_id is the smallest id reachable by links. Equal fingerprints are one class, however many rows have it, so
    copies make no links. A null or empty text has fingerprint zero and links like any other. Rows with a null id get
    their group's smallest id; if all ids of a group are null, so is its component_id. Repeated rows stay. An empty
    table gives an empty one.
    """
    prints, known = _grouped(docs, id_col, text_col, shingle)
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = known.join(least, "component").select("fp", F.col("least.doc_id").alias("component_id"))
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each group of `simhash_groups`: the smallest id, null last, then the smallest hash of text.

    Of rows that agree in both, one stays.
    """
    _, known = _grouped(docs, id_col, text_col, shingle)
    first = known.groupBy("component").agg(F.min("first").alias("first"))
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    keys = [free_name(docs, c) for c in ("_s_none", "_s_id", "_s_hash")]
    chosen = first.select(
        F.col("first.none").alias(keys[0]), F.coalesce("first.doc_id", zero).alias(keys[1]), F.col("first.text_hash").alias(keys[2])
    )
    own, nth = F.col(f"`{id_col}`"), free_name(docs, "_s_nth")
    keyed = docs.withColumns(dict(zip(keys, (own.isNull(), F.coalesce(own, zero), F.xxhash64(F.col(f"`{text_col}`"))))))
    kept = keyed.join(chosen, keys, "left_semi")
    # The join has dealt and sorted the rows by these keys already.
    kept = kept.withColumn(nth, F.row_number().over(W.partitionBy(*keys).orderBy(*keys))).where(F.col(nth) == 1)
    return kept.select(*(f"`{c}`" for c in docs.columns))
