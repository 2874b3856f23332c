import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import words

from gritsieve.llm import prefix_trie as trie
from gritsieve.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(words(p[-1][1])) if p else 0)
        for q in children[p]:
            leaves, saved = leaves + sums[q][0], saved + sums[q][1]
        sums[p] = leaves, saved
    return sorted(
        (m[0], len(p), -1 if not p else members[p[:-1]][0], len(m), len(children[p]), *sums[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def result(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert result(op13_prefix_trie(spark, sf)) == expected(rows)


def messy():
    rng = random.Random(11)
    rows = []
    for c in rng.sample(range(400), 220):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([None, turn, turn]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "c", None, "", "d e f"])))
    rows += [(1000 + i, t, "user", "the same words") for i in range(900) for t in range(3)]
    rows += [(7, 1, "x", "twice")] * 3 + [(None, 1, "user", "nobody"), (81, None, None, None), (2001, 0, "u", "w " * 100_000)]
    return rows


@pytest.mark.parametrize("shard_rows, segment", [(200_000, 1 << 16), (40, 2)])
def test_copies_ties_nulls_and_small_shards(spark, shard_rows, segment):
    rows = messy()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", hi string, depth int").repartition(5)
    assert result(trie.prefix_trie(df, shard_rows, segment)) == expected(rows)


def test_one_conversation_with_most_of_the_rows(spark):
    rows = [(20, t, "user", f"w{t % 7}") for t in range(3000)] + [(c, t, "user", f"w{t % 7}") for c in (21, 22, 40) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(trie.prefix_trie(df, 500, 256)) == expected(rows)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slots_are_minimal_and_know_their_digests():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        hi, lo = (rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(2))
        hi[: n // 2] = 9
        table = trie.Slots(hi, lo)
        assert sorted(table.find(hi, lo)) == list(range(n))
        assert set(table.find(hi, lo + np.uint64(1))) <= {-1}


def test_a_digest_of_two_prefixes_is_an_error(spark):
    path = spark.createDataFrame(
        [(1, 1, 1, "a", 1, 5, 5, 0, 0), (2, 1, 1, "b", 1, 5, 5, 0, 0)],
        "conv_id long, depth long, total long, turn_hash string, n_words long, hi long, lo long, above_hi long, above_lo long")
    with pytest.raises(RuntimeError):
        trie.nodes_of(path)
