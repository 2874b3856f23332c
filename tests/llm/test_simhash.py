import random

import numpy as np
from brute import simhash, smallest

from gritsieve.llm.queries import op4_simhash
from gritsieve.llm.simhash import _forest, fingerprint, fingerprint_links, simhash_groups


def expected(pairs):
    prints = [(i, simhash(t)) for i, t in pairs]
    return {(i, f"{p:016x}", c) for (i, p), c in zip(prints, smallest(prints, lambda a, b: (a ^ b).bit_count() <= 3))}


def test_whole_table(spark, sf):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op4_simhash(spark, sf).collect()
    assert len(got) == len(pairs)
    assert {tuple(r) for r in got} == expected(pairs)


def test_edges_nulls_and_clashing_names(spark, edges):
    pairs = edges + [(None, "one"), (3, "one"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in pairs], "doc_id long, text string, fp long, a string")
    got = simhash_groups(docs).collect()
    want = expected(pairs)
    assert len(got) == len(pairs) and {tuple(r) for r in got} == want


def test_empty(documents):
    assert simhash_groups(documents([])).collect() == []


def test_parts_do_not_change_a_fingerprint():
    text = " ".join(random.Random(1).choices(["ab", "c", "def", "G"], k=700_000))
    assert fingerprint(text.encode()) == simhash(text)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(120)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    items = [(p, p) for p in sorted(prints)]
    want = dict(zip((p for p, _ in items), smallest(items, lambda a, b: (a ^ b).bit_count() <= 3)))
    signed = [int(np.uint64(p).view(np.int64)) for p, _ in items]
    for block in (2048, 16):
        links = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()
        pairs = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        up = {p: p for p, _ in items}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
        assert {p: find(p) for p, _ in items} == want


def test_a_group_yields_fewer_links_than_members():
    fps = np.array([1 << b for b in range(20)], dtype=np.uint64)
    assert len(list(_forest(fps))) == 19
