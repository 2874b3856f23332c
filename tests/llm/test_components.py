import random

from brute import Union

from gritsieve.llm.components import components


def check(spark, pairs):
    union = Union()
    for a, b in pairs:
        if a != b:
            union.join(a, b)
    least = {}
    for x in union.up:
        root = union.find(x)
        least[root] = min(x, least.get(root, x))
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = [(r.node, r.component) for r in components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: least[union.find(x)] for x in union.up}


def test_chain_star_loops_and_repeats(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000 + i, 1000) for i in range(1, 50)]
    check(spark, chain + star + [(5000, 5000), (-7, -3), (-3, -7), (-3, 9000)])


def test_random_links(spark):
    rng = random.Random(2)
    check(spark, [(rng.randrange(400) * 7 - 900, rng.randrange(400) * 7 - 900) for _ in range(350)])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
