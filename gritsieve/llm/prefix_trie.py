"""Trie of conversation prefixes: distinct prefix digests as nodes, subtree sums by node tables of flat arrays in shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.shared import WORD, discard, stored
from gritsieve.operators.ranks import lookup, placed

#: Production parameters: conversations of one family share the first turns of its first member, fewer than HEADS.
FAMILY = 20
HEADS = 4
#: Rows of a shard, about, and turns of one path in a shard at most.
SHARD_ROWS = 200_000
SEGMENT = 1 << 16
#: Ids written into one piece of text, of which a member list is hashed.
PIECE = 256

_LANES = ("l0", "l1", "l2", "l3")
_NODE = ["hi", "lo"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_hash, n_words) of every row with a conv_id: by turn, null first, then role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        # The length of the role keeps (role, text) apart from any other pair with the same letters.
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    turn = F.col("turn").asc_nulls_first()
    return placed(
        rows, ["conv_id"], [turn, F.col("role"), F.col("text")], rank="pos",
        deal=[turn, F.substring("role", 1, 64), F.substring("text", 1, 64)], drop=["turn", "role", "text"],
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, total, turn_hash, n_words): each conversation after its family's head, and depth 0 for each.

    The first h turns are those of conversation c - c % FAMILY, h = crc32(c) % HEADS; its own turns follow after their first h.
    """
    lengths = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    convs = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    bases = lengths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
    ), "conversations")
    own = lookup(turns, convs, ["conv_id"], "inner").where("pos > h").select(
        "conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "total", "turn_hash", "n_words")
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.join(heads, "base").where("pos <= head").select("conv_id", F.col("pos").alias("depth"), "total", "turn_hash", "n_words")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit("").alias("turn_hash"), F.lit(0).cast("long").alias("n_words"))
    return own.unionByName(heads).unionByName(roots)


def _packed(first: Column, second: Column) -> Column:
    mask = F.lit((1 << 32) - 1)
    return F.shiftleft(first.bitwiseAND(mask), 32).bitwiseOR(second.bitwiseAND(mask))


def paths(turns: DataFrame) -> DataFrame:
    """`rebuilt` with the digest of each prefix (hi, lo) and of the prefix before it (above_hi, above_lo).

    A prefix's digest is the sum of its turns' digests in four lanes of 32 bits, each turn hashed with its depth. So sums
    can be run over parts of a conversation, and one of very many turns needs no task of its own.
    """
    rows = rebuilt(turns)
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_hash")), 256)
    lane = lambda i: F.when(F.col("depth") > 0, F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("long")).otherwise(0)
    rows = rows.withColumn("_hash", hashed).withColumns({f"own_{n}": lane(i) for i, n in enumerate(_LANES)}).drop("_hash")
    rows = placed(rows, ["conv_id"], [F.col("depth")], sums={n: F.col(f"own_{n}") for n in _LANES})
    mod = lambda c: F.pmod(c, F.lit(1 << 32))
    now = [mod(F.col(n)) for n in _LANES]
    above = [mod(F.col(n) - F.col(f"own_{n}")) for n in _LANES]
    return rows.select(
        "conv_id", "depth", "total", "turn_hash", "n_words", _packed(now[0], now[1]).alias("hi"), _packed(now[2], now[3]).alias("lo"),
        _packed(above[0], above[1]).alias("above_hi"), _packed(above[2], above[3]).alias("above_lo"),
    )


def nodes_of(path: DataFrame) -> DataFrame:
    """(hi, lo, depth, above_hi, above_lo, conv_id, n_convs, leaf, worth): one row per distinct prefix.

    conv_id is the smallest member; worth is what sharing the last turn saves. Members of one digest must agree in depth,
    last turn and the digest above, else it stands for two prefixes and an error is raised.
    """
    same = ("depth", "turn_hash", "above_hi", "above_lo")
    nodes = path.groupBy("hi", "lo").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"),
        (F.max(F.col("depth") < F.col("total")) == F.lit(False)).alias("leaf"),
        *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"max_{c}") for c in same),
    )
    nodes = stored(nodes, "nodes")
    if nodes.where(" or ".join(f"{c} <> max_{c}" for c in same)).limit(1).count():
        raise RuntimeError("two prefixes share a digest")
    worth = ((F.col("n_convs") - 1) * F.col("n_words")).alias("worth")
    return nodes.select("hi", "lo", "depth", "above_hi", "above_lo", "conv_id", "n_convs", "leaf", worth)


class Slots:
    """Minimal perfect hash of distinct 128-bit digests: n of them get the places 0 to n-1.

    Level by level, digests alone in their cell of a bit table stay, and the others go on to the next level; a digest's
    slot is the number of set cells before its own. Each slot keeps its digest, so a strange one is told apart.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        rest, done = np.arange(len(hi)), 0
        while len(rest):
            cell = self._cells(hi[rest], lo[rest], len(self.levels), 2 * len(rest) + 1)
            bits = np.bincount(cell, minlength=2 * len(rest) + 1) == 1
            ranks = np.cumsum(bits) - 1 + done
            alone = bits[cell]
            slots = ranks[cell[alone]]
            self.hi[slots], self.lo[slots] = hi[rest[alone]], lo[rest[alone]]
            self.levels.append((bits, ranks))
            done += int(alone.sum())
            rest = rest[~alone]

    @staticmethod
    def _cells(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 if it is none of the table's."""
        out = np.full(len(hi), -1, dtype=np.int64)
        rest = np.arange(len(hi))
        for level, (bits, ranks) in enumerate(self.levels):
            cell = self._cells(hi[rest], lo[rest], level, len(bits))
            hit = bits[cell]
            out[rest[hit]] = ranks[cell[hit]]
            rest = rest[~hit]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def _accumulated(rows: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of one shard: counts scattered into flat arrays by slot, then added to the slot above, deepest first."""
    unsigned = lambda c: rows[c].to_numpy(dtype=np.int64).view(np.uint64)
    hi, lo = unsigned("hi"), unsigned("lo")
    order = np.lexsort((lo, hi))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    one = order[fresh]
    table = Slots(hi[one], lo[one])
    slot = table.find(hi, lo)
    n = len(one)
    worth, leaves, depth, above = (np.zeros(n, dtype=np.int64) for _ in range(4))
    np.add.at(worth, slot, rows["worth"].to_numpy(dtype=np.int64))
    np.add.at(leaves, slot, rows["leaves"].to_numpy(dtype=np.int64))
    depth[slot] = rows["depth"].to_numpy(dtype=np.int64)
    above[slot] = table.find(unsigned("above_hi"), unsigned("above_lo"))
    above[slot[rows["top"].to_numpy(dtype=bool)]] = -1
    deepest = np.argsort(-depth, kind="stable")
    for at in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
        at = at[above[at] >= 0]
        np.add.at(worth, above[at], worth[at])
        np.add.at(leaves, above[at], leaves[at])
    return pd.DataFrame({"hi": table.hi.view(np.int64), "lo": table.lo.view(np.int64), "n_leaves": leaves, "saved_tokens": worth})


def subtree_sums(path: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """(hi, lo, n_leaves, saved_tokens): what the nodes below and at each node add up to.

    A node belongs to its smallest member, and so do the nodes of that member's path below it: paths of members that own
    nothing are copies and fall out. Shards take whole paths by hash, in segments of `segment` turns; a shard adds up what
    its paths own, and partial sums of nodes that several shards know are added. What lies below a segment on its own
    path reaches it as one number.
    """
    owned = nodes.select("conv_id", "depth", "worth", F.col("leaf").cast("long").alias("leaves"))
    cut = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / segment).cast("long").alias("segment")
    marked = stored(path.select("conv_id", "depth", "total", "hi", "lo", "above_hi", "above_lo", cut).join(
        owned, ["conv_id", "depth"], "left"), "marked")
    owners = stored(marked.where("depth = total and worth is not null").select("conv_id"), "owners")
    rows = lookup(marked, owners, ["conv_id"], "inner").fillna(0, ["worth", "leaves"])
    long = rows.where(F.col("total") > segment)
    below = W.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = long.groupBy("conv_id", "segment").agg(F.sum("worth").alias("worth"), F.sum("leaves").alias("leaves")).select(
        "conv_id", "segment", F.sum("worth").over(below).alias("worth"), F.sum("leaves").over(below).alias("leaves")).where("worth > 0 or leaves > 0")
    last = long.where((F.col("depth") == (F.col("segment") + 1) * segment) & (F.col("depth") < F.col("total"))).drop("worth", "leaves")
    rows = stored(rows.unionByName(last.join(carried, ["conv_id", "segment"])), "shard-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    # The first turn of a segment does not reach beyond it, even where a shard holds the path above: `carried` does.
    top = (F.col("depth") == 0) | ((F.col("depth") > 1) & ((F.col("depth") - 1) % segment == 0))
    keyed = rows.select(top.alias("top"), F.pmod(F.xxhash64("conv_id", "segment"), F.lit(shards)).alias("shard"),
                        "hi", "lo", "above_hi", "above_lo", "depth", "worth", "leaves")
    sums = keyed.groupBy("shard").applyInPandas(_accumulated, "hi long, lo long, n_leaves long, saved_tokens long")
    out = stored(sums.groupBy("hi", "lo").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")
    for done in (marked, owners, rows):
        discard(done)
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of a sorted partition as comma-joined pieces of at most PIECE ids of one node."""
    for batch in batches:
        hi, lo, ids = (batch[c].to_numpy() for c in ("hi", "lo", "conv_id"))
        starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(ids) else []
        ends = np.append(starts[1:], len(ids)) if len(ids) else []
        cuts = [(a, min(a + PIECE, e)) for s, e in zip(starts, ends) for a in range(s, e, PIECE)]
        yield pd.DataFrame({
            "hi": [hi[a] for a, _ in cuts], "lo": [lo[a] for a, _ in cuts], "first": [ids[a] for a, _ in cuts],
            "piece": [",".join(map(str, ids[a:b].tolist())) for a, b in cuts],
        }).astype({"hi": "int64", "lo": "int64", "first": "int64"})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces in order, comma-joined; only the hash's state is held."""
    key, state = None, None
    for batch in batches:
        done = []
        for hi, lo, piece in zip(batch["hi"].tolist(), batch["lo"].tolist(), batch["piece"]):
            if (hi, lo) == key:
                state.update(b",")
            else:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (hi, lo), hashlib.sha256()
            state.update(piece.encode())
        yield pd.DataFrame(done, columns=["hi", "lo", "ends_sha256"]).astype({"hi": "int64", "lo": "int64"})
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["hi", "lo", "ends_sha256"])


def ends_of(path: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which conversations end.

    Ids are dealt in ranges of node and id and joined to pieces there, so that a node at which a third of all
    conversations end is written by many tasks; one task then runs the hash, which is sequential, over its pieces.
    """
    ends = path.where("depth = total").select("hi", "lo", "conv_id")
    pieces = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInPandas(
        _pieces, "hi long, lo long, first long, piece string")
    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInPandas(
        _hashed, "hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the textless root.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Turns stand in the order of turn (null first), then role, then text; null roles and texts are empty;
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. Other columns
    are ignored; an empty table gives an empty one. Remainders of negative ids are negative, as in SQL.
    """
    turns = stored(ordered_turns(conversations), "turns")
    path = stored(paths(turns), "paths")
    nodes = nodes_of(path)
    nodes = stored(nodes, "trie")
    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("above_hi").alias("hi"), F.col("above_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("hi").alias("above_hi"), F.col("lo").alias("above_lo"), F.col("conv_id").alias("parent_conv_id"))
    linked = lookup(stored(below, "below"), above, ["above_hi", "above_lo"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = linked.unionByName(root).join(children, _NODE, "left").join(subtree_sums(path, nodes, shard_rows, segment), _NODE, "left")
    out = out.join(ends_of(path), _NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
