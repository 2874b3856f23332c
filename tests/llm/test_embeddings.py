import os
import random
from contextlib import contextmanager, suppress
from threading import Event, Thread

import numpy as np
import pytest
from brute import smallest

from gritsieve.llm.embeddings import Tree, _links, _rotation, _unit, similar_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def valid(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    if not (valid(a) and valid(b)) or len(a) != len(b):
        return -2
    a, b = (np.array(np.float32(v), dtype=np.float64) for v in (a, b))
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def expected(rows):
    linked = lambda a, b: cosine(a, b) >= 0.9
    links = [sum(linked(a, b) for j, (_, b) in enumerate(rows) if j != i) for i, (_, a) in enumerate(rows)]
    return sorted(((i, n, c, i is not None and i == c) for (i, _), n, c in zip(rows, links, smallest(rows, linked))), key=str)


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            out.append((centre + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.35])).astype(np.float32).tolist())
    return out[:n]


@pytest.mark.parametrize(("dim", "sample", "block"), [(3, 8, 16), (16, 1024, 2048), (16, 20, 30)])
def test_against_all_pairs(spark, dim, sample, block):
    rows = list(enumerate(vectors(dim, 260, dim)))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = similar_vectors(df, sample=sample, block=block).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_edges(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(5, good), (4, good), (4, good), (3, [2.0, 4.0, 6.0]), (None, good), (2, None), (1, []), (0, [0.0, 0.0, 0.0]),
            (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 2.0]),
            (11, [1.0, 2.0, 3.0, 4.0]), (12, [-0.0, 1.0, 0.0]), (13, [0.0, 1.0, 0.0]), (None, None), (14, [1e-30, 2e-30, 3e-30])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", "1 as n", "2 as class_id", "3 as cell")
    assert sorted(map(tuple, similar_vectors(df).collect()), key=str) == expected(rows)
    assert similar_vectors(df.limit(0)).collect() == []
    assert {r.n_links for r in similar_vectors(df.where("embedding is null")).collect()} == {0}


def test_one_huge_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.02).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = similar_vectors(df, block=100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(899, 0)}


@contextmanager
def shuffled(spark):
    """Bytes of the shuffle files that are made inside the block; their greatest sizes, as Spark deletes them in between."""
    roots = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    sizes, before, over = {}, set(), Event()

    def look():
        for path in (f"{d}/{f}" for root in roots for d, _, names in os.walk(root) for f in names if f.startswith("shuffle_")):
            with suppress(OSError):
                sizes[path] = max(sizes.get(path, 0), os.path.getsize(path))

    def watch():
        while not over.wait(0.02):
            look()

    look()
    before.update(sizes)
    watching = Thread(target=watch)
    watching.start()
    total = []
    try:
        yield total
    finally:
        over.set()
        watching.join()
        look()
        total.append(sum(n for path, n in sizes.items() if path not in before))


def test_pairs_of_blocks_are_not_written(spark):
    n, dim = 1500, 32
    numbers = np.random.default_rng(5).normal(size=(n, dim)).astype(np.float32)
    numbers[n - 50 :] = numbers[:50] * 2
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(numbers)], SCHEMA).repartition(4)
    with shuffled(spark) as written:
        got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df, block=30).collect()}
    assert got == {i: (1, i % (n - 50)) if i < 50 or i >= n - 50 else (0, i) for i in range(n)}
    # 50 blocks make 1,275 pairs; a block and its partner have 15 KB and more.
    assert 0 < written[0] < 6 * numbers.nbytes + (1 << 20)


@pytest.mark.parametrize(("dim", "n", "levels"), [(2, 1500, 4), (3, 1500, 2), (64, 700, 1)])
def test_links_of_two_blocks(dim, n, levels):
    rng = np.random.default_rng(dim)
    numbers = rng.normal(size=(2 * n, dim)) * 10.0 ** rng.integers(-30, 30, size=(2 * n, 1))
    for i in range(0, 2 * n, 20):  # near copies of every size and angle
        numbers[i + 1 : i + 20] = numbers[i] + np.abs(numbers[i]).max() * rng.normal(size=(19, dim)) * rng.choice([0.05, 0.2, 0.4])
    numbers = rng.permutation(numbers)
    unit = _unit(numbers)
    rotation = _rotation(_unit(rng.normal(size=(1024, dim))), 0.9)
    assert (rotation is not None) == (dim == 64)
    blocks = [Tree(at, np.ones(n, dtype=np.int64), numbers[at]) for at in (np.arange(n), np.arange(n, 2 * n))]
    assert len(blocks[0].levels) == levels
    for block in blocks:
        block.prepare(rotation)
    for a, b in ((blocks[0], blocks[1]), (blocks[0], blocks[0])):
        found = np.zeros((2 * n, 2 * n), dtype=int)
        for left, right, linked in _links(a, b, 0.9):
            found[(a.ids[left], b.ids[right]) if linked is None else np.ix_(a.ids[left], b.ids[right])] += 1 if linked is None else linked
        expected = np.zeros((2 * n, 2 * n), dtype=int)
        expected[np.ix_(a.ids, b.ids)] = unit[a.ids] @ unit[b.ids].T >= 0.9
        if a is b:
            np.fill_diagonal(expected, 0)
        assert (found == expected).all() and expected.sum() > n
