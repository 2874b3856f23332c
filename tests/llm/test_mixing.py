import random

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from gritsieve.llm.mixing import _hypergeometric, draws, mix_counts, mixed_documents, placed, split_quotas


def fill(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, still = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    for _ in range(10_000):
        total = sum(weight[s] for s in still)
        if left < 1e-9 or not total:
            break
        share, left = left / total, 0.0
        for s in list(still):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                still.discard(s)
    return target


def check(pairs, got):
    sizes = {}
    for (_, text), source in pairs:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = fill(sizes)
    assert sorted(map(str, ((i, len(words(t)), sizes[s], round(target[s], 3)) for (i, t), s in pairs))) == sorted(
        map(str, ((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got)))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, round(r.target, 3)), []).append(r.taken)
    for s in sizes:
        same = [x for x in sizes if sizes[x] == sizes[s] and round(target[x], 3) == round(target[s], 3)]
        assert abs(sum(by_target[sizes[s], round(target[s], 3)]) - sum(target[x] for x in same)) <= 0.51 * len(same)


@pytest.fixture
def mixed(documents, edges):
    rng = random.Random(3)
    pairs = [((i, t), None) for i, t in edges if i != 8] + [((i, "w " * rng.randint(0, 90)), f"s{rng.randint(0, 6)}") for i in range(20, 200)]
    pairs += [((None, "a b c"), "s1"), ((None, "a b c"), "s1"), ((50, "x y"), "s2"), ((300, ""), "none"), ((301, "ä b"), "é")]
    names = {id(t): s for (_, t), s in pairs}
    rows = [(i, t, "en", s, 0) for (i, t), s in pairs]
    assert names
    return pairs, documents([]).sparkSession.createDataFrame(rows, documents([]).schema).repartition(4)


def test_counts(mixed):
    pairs, docs = mixed
    first, again = mix_counts(docs).collect(), mix_counts(docs.repartition(2)).collect()
    check(pairs, first)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_parts_are_disjoint_and_whole(mixed):
    _, docs = mixed
    rows = placed(docs, "doc_id", "text", "source")
    parts = draws(rows, block_words=16, blocks_per_shard=8).collect()
    taken = {}
    for p in parts:
        for w in range(p.first_word, p.first_word + p.n_words):
            assert (p.no, p.at, p.turn, w) not in taken and w < p.size
            taken[p.no, p.at, p.turn, w] = p.shard
    assert len({p.shard for p in parts}) > 4
    assert len({(p.shard, p.place) for p in parts}) == len(parts)
    per_no = {}
    for p in parts:
        per_no[p.no] = per_no.get(p.no, 0) + p.n_words
    assert per_no == {r.no: r.draw for r in rows.select("no", "draw").distinct().collect() if r.draw}


def test_documents(mixed):
    pairs, docs = mixed
    counts = {}
    for r in mix_counts(docs).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixed_documents(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {i: n for i, n in counts.items() if n}


def test_tree_adds_up_and_follows_its_distribution(spark):
    quotas = [40, 0, 1000, 7, 300]
    leaves = split_quotas(spark.createDataFrame([(quotas,)], "v array<long>"), 5).collect()
    assert len(leaves) == 32 and {r.shard for r in leaves} == set(range(32))
    assert np.array([r.v for r in leaves]).sum(0).tolist() == quotas
    sums = [sum(r.v) for r in leaves]
    assert max(sums) - min(sums) <= 1
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    lit = lambda x: F.lit(x).cast("long")
    drawn = np.array([r[0] for r in u.select(_hypergeometric(lit(30), lit(100), lit(20), F.col("u"))).collect()])
    assert abs(drawn.mean() - 6) < 0.01 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.02
    large = u.select(_hypergeometric(lit(10**9), lit(3 * 10**9), lit(10**8), F.col("u"))).limit(3).collect()
    assert all(abs(r[0] - 10**8 / 3) < 10**5 for r in large)


def test_empty_and_clashing_names(documents):
    assert mix_counts(documents([])).collect() == []
    docs = documents([(1, "a b"), (2, "c")]).selectExpr("*", "1 as taken", "2 as no", "3 as size", "4 as at")
    assert {(r.doc_id, r.size) for r in mix_counts(docs).collect()} == {(1, 2), (2, 1)}
    assert set(mixed_documents(docs).columns) == set(docs.columns)
