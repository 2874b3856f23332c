"""Near-duplicate vectors by cosine: a cover tree in blocks, and dual traversal of pairs of blocks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.components import components
from gritsieve.llm.shared import discard, stored

#: Production parameters.
THRESHOLD = 0.9
#: Distinct vectors from which the centres of the top level are chosen, first by hash; every vector is indexed.
SAMPLE = 1024
#: Distinct vectors of up to 64 numbers in a block, about; of longer ones fewer, so that a block has as many numbers.
BLOCK, BLOCK_SIZE = 2048, 64
#: Blocks that a table has before its blocks get larger, up to so many times: less is handed to the tasks for as many pairs.
MANY, LARGER = 64, 4
#: Blocks that a task holds of either side, unless there are fewer for the cores.
HELD = 16
#: Covering radii: the top level's, and those inside a block, each half the one before.
TOP_RADIUS, RADII = 1.0, (0.5, 0.25, 0.125)
#: Vectors that a node must hold on average, else its level is left out: it would cost more than it prunes.
NODE = 16
#: Rows and columns of a product of two blocks that are looked at together: about what the cache of a core holds.
TILE = 512
#: Pairs left undecided by bounds that are decided together.
TOGETHER = 1 << 16
#: Share of the pairs that the first numbers of rotated vectors may leave undecided.
UNDECIDED = 3e-5
#: Bounds are compared in single precision with this slack; links are decided in double precision.
SLACK = 1e-4


def _reach(threshold: float) -> float:
    """The distance of unit vectors at that cosine."""
    return float(np.sqrt(2 - 2 * threshold))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, v, class_id) per row; v, the vector's numbers, and class_id are null where a vector cannot link.

    Numbers take four bytes each where that loses nothing, else eight. A class is the hash of the size and the numbers, so equal
    vectors are one class however many there are.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64)
            out: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                v = flat[(ends[at] - size)[:, None] + np.arange(size)] + flat.dtype.type(0)  # no negative zero
                fine = np.isfinite(v).all(1) & v.any(1)
                with np.errstate(over="ignore", invalid="ignore"):
                    short = v.astype(np.float32)
                    exact = (short == v).all(1)
                for k in np.flatnonzero(fine).tolist():
                    out[at[k]] = (short if exact[k] else v)[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(out, pa.binary())], ["vec_id", "size", "v"])

    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.mapInArrow(checked, f"vec_id {kind}, size int, v binary").withColumn(
        "class_id", F.when(F.col("v").isNotNull(), F.xxhash64("size", "v")))


def _numbers(blobs: list[bytes], size: int) -> np.ndarray:
    if all(len(x) == 4 * size for x in blobs):
        return np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(-1, size)
    return np.array([np.frombuffer(x, dtype=np.float32 if len(x) == 4 * size else np.float64) for x in blobs], dtype=np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    scaled = v / np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _net(unit: np.ndarray, radius: float, chosen: list[int], most: int) -> list[int] | None:
    """`chosen` and as many more points, in order, as are needed to have every point within `radius` of one; none if over `most`."""
    least = 1 - radius * radius / 2
    covered = np.zeros(len(unit), dtype=bool)
    for i in chosen:
        covered |= unit @ unit[i] >= least
    out = list(chosen)
    while not covered.all():
        if len(out) >= most:
            return None
        i = int(np.argmin(covered))
        out.append(i)
        covered |= unit @ unit[i] >= least
        covered[i] = True
    return out


def _rotation(unit: np.ndarray, threshold: float) -> np.ndarray | None:
    """As few principal directions of half the sample as leave few pairs of the rest undecided; none if it takes about all.

    A product is at most that of the vectors' parts along the directions plus that of the lengths of their other parts.
    """
    size, half = unit.shape[1], len(unit) // 2
    if half < 2:
        return None
    along = np.linalg.svd(unit[:half] - unit[:half].mean(0), full_matrices=False)[2].T
    unit = unit[half:]
    far = unit @ unit.T < threshold
    for n in range(8, min(along.shape[1], size - size // 8), max(4, size // 16)):
        head = unit @ along[:, :n]
        rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(1)))
        if (far & (head @ head.T + np.outer(rest, rest) >= threshold - SLACK)).sum() <= UNDECIDED * far.sum():
            return along[:, :n].astype(np.float32)
    return None


class Tree:
    """The lower levels over one block: nested nets with halving radii, and the measured covering radius of every node.

    Above them is the vector nearest to the middle. Vectors are ordered by their nodes from the top down. A level is left out,
    and those below it, if its nodes would hold only few vectors each.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray):
        unit = _unit(numbers)
        single = unit.astype(np.float32)
        chosen: list[int] | None = [int(np.argmax(unit @ unit.mean(0)))]
        self.levels, above = [], None
        for radius in (None, *RADII):
            chosen = chosen if radius is None else _net(single, radius, chosen, max(1, len(unit) // NODE))
            if chosen is None:
                break
            centres = single[chosen]
            parent = np.zeros(len(chosen), dtype=np.int64) if above is None else (centres @ above.T).argmax(1)
            self.levels.append([centres, parent, np.zeros(len(chosen))])
            above = centres
        node, path = (single @ above.T).argmax(1), []
        lowest = node
        for level in reversed(self.levels):
            to_centre = np.einsum("ij,ij->i", unit, level[0][node].astype(np.float64))
            np.maximum.at(level[2], node, np.sqrt(np.maximum(0, 2 - 2 * to_centre) + 1e-6))  # no less than it is
            path.append(node)
            node = level[1][node]
        order = np.lexsort(path)
        self.ids, self.counts, self.numbers, self.parent = ids[order], counts[order], numbers[order], lowest[order]

    def prepare(self, rotation: np.ndarray | None) -> None:
        """Sets single, the unit vectors in single precision, and head: of rotated ones the first numbers and the length of the rest."""
        v = self.numbers / np.abs(self.numbers).max(1, keepdims=True)
        self.single = self.head = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
        if rotation is not None:
            first = self.single @ rotation
            rest = np.sqrt(np.maximum(0, 1 - (first * first).sum(1)) + 1e-6)  # no less than it is
            self.head = np.column_stack([first, rest.astype(np.float32)])


def _survivors(a: Tree, b: Tree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lowest nodes that may hold a link, going down both trees level by level; a tree that ends before the other stays.

    A pair goes on only if its centres are no farther apart than both covering radii and the reach. A level's pairs are
    tested as one product of the centres whose parents are still in any pair.
    """
    pairs = None

    def level(tree: Tree, depth: int) -> tuple:
        if depth < len(tree.levels):
            return tree.levels[depth]
        centres, _, radii = tree.levels[-1]
        return centres, np.arange(len(centres)), radii

    for depth in range(max(len(a.levels), len(b.levels))):
        (ca, pa_, ra), (cb, pb, rb) = level(a, depth), level(b, depth)
        if pairs is None:
            left, right = np.arange(len(ca)), np.arange(len(cb))
        else:
            left, right = np.flatnonzero(np.isin(pa_, pairs[0])), np.flatnonzero(np.isin(pb, pairs[1]))
        # With the largest radius on the right, one bound per row; the pairs that pass are tested with their own.
        bound = ra[left] + rb[right].max(initial=0) + reach
        close = ca[left] @ cb[right].T >= (1 - bound * bound / 2 - SLACK).astype(np.float32)[:, None]
        if pairs is not None:
            open_ = np.zeros((len(above[0]), len(above[1])), dtype=bool)
            open_[pairs] = True
            close &= open_[pa_[left]][:, pb[right]]
        i, j = np.nonzero(close)
        i, j = left[i], right[j]
        bound = ra[i] + rb[j] + reach
        near = np.einsum("ij,ij->i", ca[i], cb[j]) >= 1 - bound * bound / 2 - SLACK if len(i) < 1_000_000 else slice(None)
        pairs, above = (i[near], j[near]), (ra, rb)
        if not len(pairs[0]):
            break
    return pairs


def _links(a: Tree, b: Tree, threshold: float) -> Iterator[tuple]:
    """Runs of links: points (indices of a, of b) and the matrix of their links, or none where the points are linked one by one.

    A block with itself: no point with itself, and every link from both ends.
    """
    i, j = _survivors(a, b, _reach(threshold))
    if not len(i):
        return
    open_ = np.zeros((len(a.levels[-1][0]), len(b.levels[-1][0])), dtype=bool)
    open_[i, j] = True
    some, all_open = open_.any(1)[a.parent], open_.all()
    space, passes = np.empty(TILE * TILE, dtype=np.float32), np.empty(TILE * TILE, dtype=bool)  # kept, as new pages take long
    single: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, least = 0, np.float32(threshold - SLACK)

    def decided() -> Iterator[tuple]:
        left, right = (np.concatenate(x) for x in zip(*single))
        single.clear()
        near = np.einsum("ij,ij->i", a.single[left], b.single[right]) >= least
        left, right = left[near], right[near]
        if not len(left):
            return
        linked = np.einsum("ij,ij->i", _unit(a.numbers[left]), _unit(b.numbers[right])) >= threshold
        if a is b:
            linked &= left != right
        if linked.any():
            yield left[linked], right[linked], None

    for start in range(0, len(a.ids), TILE):
        rows = start + np.flatnonzero(some[start : start + TILE])
        if not len(rows):
            continue
        cols = np.arange(len(b.ids)) if all_open else np.flatnonzero(open_[np.unique(a.parent[rows])].any(0)[b.parent])
        own, other = a.head[rows], b.head if len(cols) == len(b.ids) else b.head[cols]
        for at in range(0, len(cols), TILE):
            part = other[at : at + TILE]
            shape, n = (len(own), len(part)), len(own) * len(part)
            bound = np.matmul(own, part.T, out=space[:n].reshape(shape))
            close = np.greater_equal(bound, least, out=passes[:n].reshape(shape))
            any_ = np.flatnonzero(close.any(1))
            left, right = np.nonzero(close[any_])
            left, right = rows[any_[left]], cols[at + right]
            if len(left) < n // 128:
                single.append((left, right))
                waiting += len(left)
                if waiting > TOGETHER:
                    yield from decided()
                    waiting = 0
                continue
            left, right = np.unique(left), np.unique(right)
            linked = _unit(a.numbers[left]) @ _unit(b.numbers[right]).T >= threshold
            if a is b:
                linked &= left[:, None] != right[None]
            if linked.any():
                yield left, right, linked
    if single:
        yield from decided()


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects; fewer than its rows and columns together."""
    if linked.sum() <= sum(linked.shape):
        return [tuple(x) for x in np.argwhere(linked)]
    out, rows = [], linked.any(1)
    while rows.any():
        queue = [int(np.argmax(rows))]
        rows[queue[0]] = False
        cols = np.zeros(linked.shape[1], dtype=bool)
        while queue:
            row = queue.pop()
            for col in np.flatnonzero(linked[row] & ~cols):
                cols[col] = True
                out.append((row, int(col)))
                more = np.flatnonzero(linked[:, col] & rows)
                rows[more] = False
                out.extend((int(m), int(col)) for m in more)
                queue.extend(more.tolist())
    return out


class Report:
    """What the pairs of blocks of a task have in links: their number by class, and what they connect."""

    def __init__(self) -> None:
        self.links: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.up: dict[int, int] = {}

    def _root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: Tree, b: Tree, keys: tuple, threshold: float) -> None:
        for left, right, linked in _links(a, b, threshold):
            for key, tree in zip(keys, (a, b)):
                if key not in self.links:
                    self.links[key] = tree.ids, np.zeros(len(tree.ids), dtype=np.int64)
            if linked is None:
                np.add.at(self.links[keys[0]][1], left, b.counts[right])
                if a is not b:
                    np.add.at(self.links[keys[1]][1], right, a.counts[left])
            else:
                self.links[keys[0]][1][left] += linked @ b.counts[right]
                if a is not b:
                    self.links[keys[1]][1][right] += a.counts[left] @ linked
                found = np.array(_forest(linked))
                left, right = left[found[:, 0]], right[found[:, 1]]
            for x, y in zip(a.ids[left].tolist(), b.ids[right].tolist()):
                x, y = self._root(x), self._root(y)
                self.up[max(x, y)] = min(x, y)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(a, null, links of a), and (a, b, 0) for all connected classes, each with the least of them."""
        for ids, n in self.links.values():
            ids, n = ids[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(n)], ["a", "b", "n"])
        ends = [(x, root) for x in list(self.up) if (root := self._root(x)) != x]
        if ends:
            a, b = np.array(ends, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros_like(a))], ["a", "b", "n"])


def similar_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs with cosine >= `threshold` in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing; nor do vectors of different
    length. n_links counts the other rows linked directly, equal vectors included. component_id is the smallest id
    reachable; a row that links with nothing has its own. kept: vec_id = component_id, false for a null id. Repeated
    rows stay. An empty table gives an empty one.

    The cover tree's top level is a net of a bounded sample; every distinct vector goes to its nearest centre, and a
    centre's covering radius is measured over all of them. Vectors of a centre, or of several small ones, make blocks;
    a block holds the lower levels. Pairs of blocks whose centres' radii allow a link meet, and the two trees are descended
    together. No link is left out: only bounds prune. Blocks meet as a product of the stored table with itself, a task for
    some blocks of either side, so that no pair of blocks is written. Tasks report counts, and what their links connect.
    """
    vectors = vectors_of(table, id_col, vector_col)
    rows = stored(vectors.select("vec_id", "class_id"), "vectors")
    first = rows.where("class_id is not null").select("class_id").distinct().orderBy(
        F.xxhash64(F.lit(1), "class_id"), "class_id").limit(sample)
    known = vectors.join(F.broadcast(first), "class_id").groupBy("class_id").agg(F.first("size").alias("size"), F.first("v").alias("v"))
    known = sorted(known.collect())
    centres: dict[int, np.ndarray] = {}
    rotations: dict[int, np.ndarray | None] = {}
    for size in {r["size"] for r in known}:
        unit = _unit(_numbers([bytes(r["v"]) for r in known if r["size"] == size], size))
        centres[size] = unit[_net(unit, TOP_RADIUS, [], len(unit))]
        rotations[size] = _rotation(unit, threshold)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cells, away = np.zeros(len(sizes), dtype=np.int32), np.full(len(sizes), 2.0)
            for size, centre in centres.items():
                at = np.flatnonzero(sizes == size)
                for run in np.array_split(at, -(-len(at) // 2048) or 1):
                    if len(run):
                        unit = _unit(_numbers(batch.column("v").take(pa.array(run)).to_pylist(), size))
                        cells[run] = (unit @ centre.T).argmax(1)
                        away[run] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit, centre[cells[run]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], [*batch.schema.names, "cell", "away"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    classes = vectors.where("class_id is not null").groupBy("class_id").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("size").alias("size"), F.first("v").alias("v"))
    placed = stored(classes.mapInArrow(to_cells, f"class_id long, n long, least {kind}, size int, v binary, cell int, away double"), "cells")
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("members"), F.max("away").alias("radius")).orderBy("size", "cell")
    groups, met = _groups(cells.collect(), centres, _reach(threshold), block)
    links = _meet(placed, groups, met, rotations, threshold)

    # A stored table holds both reports: counts have no b.
    counts = links.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("links"))
    groups_of = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "class_id")
    whole = placed.select("class_id", "n", "least").join(counts, "class_id", "left").join(groups_of, "class_id", "left")
    whole = whole.withColumn("component", F.coalesce("component", "class_id"))
    smallest = whole.groupBy("component").agg(F.min("least").alias("smallest"))
    known = whole.join(smallest, "component").select(
        "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "smallest")
    out = rows.join(known, "class_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class_id").isNull(), F.col("vec_id")).otherwise(F.col("smallest")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _meet(placed: DataFrame, groups: dict, met: dict[int, list[int]], rotations: dict, threshold: float) -> DataFrame:
    """The stored reports of all pairs of blocks that may hold a link."""
    spark = placed.sparkSession
    home = spark.createDataFrame([(s, c, g, parts) for (s, c), (g, parts) in groups.items()], "size int, cell int, g int, parts int")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class_id")
        numbers = _numbers(frame["v"].tolist(), int(frame["size"].iloc[0]))
        tree = Tree(frame["class_id"].to_numpy(), frame["n"].to_numpy(), numbers)
        return pd.DataFrame({"g": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree)]})

    dealt = placed.join(F.broadcast(home), ["size", "cell"]).select(
        "g", F.pmod(F.xxhash64(F.lit(2), "class_id"), "parts").cast("int").alias("part"), "class_id", "n", "size", "v")
    blocks = stored(dealt.groupBy("g", "part").applyInPandas(build, "g int, part int, tree binary"), "blocks", maxRecordsPerFile=1)

    # A task holds some blocks of either side, and there are tasks for all cores. Each block comes once: a left one with the first
    # row of the right side, and a right one with the first of the left side.
    n = sum(dict(groups.values()).values())
    shares = max(-(-n // HELD), min(n, round(3 * spark.sparkContext.defaultParallelism ** 0.5)), 1)
    partners = spark.createDataFrame(list(met.items()), "g int, partners array<int>")
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of its partition
    left = blocks.coalesce(shares).join(F.broadcast(partners), "g").select(
        F.col("g").alias("ag"), F.col("part").alias("ap"), "partners", F.col("tree").alias("a"), opens.alias("a_opens"))
    right = blocks.coalesce(shares).select(
        F.col("g").alias("bg"), F.col("part").alias("bp"), F.col("tree").alias("b"), opens.alias("b_opens"))
    held = left.hint("shuffle_replicate_nl").join(right, F.col("a_opens") | F.col("b_opens")).select(
        "ag", "ap", "partners", F.when(F.col("b_opens"), F.col("a")).alias("a"), "bg", "bp", F.when(F.col("a_opens"), F.col("b")).alias("b"))
    links = stored(held.mapInArrow(_traversal(rotations, threshold), "a long, b long, n long"), "links")
    discard(blocks)
    return links


def _traversal(rotations: dict, threshold: float) -> Callable:
    """What a task does with the blocks it holds: all of the right side come with the first of the left side."""

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, own, others = Report(), None, {}

        def load(column: pa.Array, k: int) -> Tree:
            tree = pickle.loads(column[k].as_buffer())
            tree.prepare(rotations.get(tree.numbers.shape[1]))
            return tree

        def meet(key: tuple[int, int], partners: set[int], tree: Tree) -> None:
            for other_key, other in others.items():
                # Of two blocks, one or the other is the left one, by parity, so that no task has all pairs.
                first = key <= other_key if sum(key + other_key) % 2 == 0 else key > other_key
                if first and other_key[0] in partners:
                    report.add(tree, tree if other_key == key else other, (key, other_key), threshold)

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            new = zip(a.is_valid().to_pylist(), b.is_valid().to_pylist())
            keys = zip(*(batch.column(x).to_pylist() for x in ("ag", "ap", "bg", "bp")))
            for k, ((new_a, new_b), (ag, ap, bg, bp)) in enumerate(zip(new, keys)):
                if new_a:
                    if own:
                        meet(*own)
                    own = (ag, ap), set(batch.column("partners")[k].as_py()), load(a, k)
                if new_b:
                    others[bg, bp] = load(b, k)
        if own:
            meet(*own)
        yield from report.batches()

    return traverse


def _chained(unit: np.ndarray) -> list[int]:
    """An order of the points in which each is followed by the nearest that is left."""
    out, left = [0], np.ones(len(unit), dtype=bool)
    while len(out) < len(unit):
        left[out[-1]] = False
        out.append(int(np.where(left, unit @ unit[out[-1]], -2).argmax()))
    return out


def _groups(cells: list, centres: dict[int, np.ndarray], reach: float, block: int) -> tuple[dict, dict[int, list[int]]]:
    """Cells put together to blocks, and for each group those with which it may hold a link, itself among them.

    Small cells join near ones until they fill a block, a large one is dealt in parts. There are as many cells as the sample
    has vectors at most, so this is bounded. Two groups meet if any two of their cells do: the centres lie no farther apart
    than both covering radii and the reach. Cells without a centre (a vector length that the sample missed) meet all.
    """
    by_size: dict[int, list] = {}
    for c in cells:
        by_size.setdefault(c["size"], []).append(c)
    groups, parts, met, g = {}, {}, {}, -1
    block *= min(LARGER, max(1, sum(c["members"] for c in cells) // (MANY * block)))
    for size, own in by_size.items():
        most, filled = max(1, min(block, block * BLOCK_SIZE // size)), None
        near = np.ones((len(own), len(own)), dtype=bool)
        if size in centres:
            own = [own[k] for k in _chained(centres[size][[c["cell"] for c in own]])]
            unit, radius = centres[size][[c["cell"] for c in own]], np.array([c["radius"] for c in own])
            near = np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit.T))) <= radius[:, None] + radius[None] + reach + 1e-7
        for c in own:
            if filled is None or filled + c["members"] > most:
                g, filled = g + 1, 0
            filled += c["members"]
            parts[g] = max(parts.get(g, 1), -(-c["members"] // most))
            groups[size, c["cell"]] = g
        at = np.array([groups[size, c["cell"]] for c in own])
        i, j = np.nonzero(near)
        for a, b in set(zip(at[i].tolist(), at[j].tolist())):
            met.setdefault(a, []).append(b)
    return {key: (g, parts[g]) for key, g in groups.items()}, met
