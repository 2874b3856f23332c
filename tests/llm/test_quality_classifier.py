import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.llm.quality_classifier import classify, fit, site_posteriors


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return tuple(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = classify(docs, labels.where("doc_id % 5 <> 0")).join(
        labels.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")).where("doc_id % 5 = 0"), "doc_id").collect()
    assert len(rows) > 500
    assert np.mean([(r.quality >= 0.5) == (r.q == 1) for r in rows]) > 0.98
    clean = [r.kept for r in rows if r.q == 1 and r.t == 0]
    assert np.mean(clean) > 0.98
    toxic = [r.toxic for r in rows if r.t == 1]
    assert np.mean(toxic) > 5 * np.mean([r.toxic for r in rows if r.t == 0])


def test_posteriors_follow_the_formula(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"h{i % 4}" if i % 4 else None, f"p{i % 3}", float(rng.uniform(0.05, 0.15) + 0.8 * (i % 4 == 1))) for i in range(400)]
    rows += [(900, "rare", "p0", 0.9), (901, "rare", "p0", 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string, p double").repartition(3)
    got = {r.doc_id: r for r in site_posteriors(df, "p", ["a", "b"]).collect()}
    assert len(got) == len(rows)
    mean = np.mean([r[3] for r in rows])
    groups = {}
    for _, a, _, p in rows:
        groups.setdefault(a, []).append(p)

    def strength(stats):
        n, s, above = (np.array(x) for x in zip(*stats))
        chance = above * (1 - above)
        ratio = max(1e-6, ((n * (s / n - above) ** 2).sum() - chance.sum()) / ((n * chance).sum() - chance.sum()))
        return min(max((1 - ratio) / ratio, 1), 1e6)

    k0 = strength([(len(v), sum(v), mean) for v in groups.values()])
    host = {a: (sum(v) + k0 * mean) / (len(v) + k0) for a, v in groups.items()}
    paths = {}
    for _, a, b, p in rows:
        paths.setdefault((a, b), []).append(p)
    k1 = strength([(len(v), sum(v), host[a]) for (a, _), v in paths.items()])
    for i, a, b, p in rows:
        v = paths[a, b]
        want = (sum(v) - p + k1 * host[a]) / (len(v) - 1 + k1)
        assert abs(got[i].prior - min(max(want, 1e-4), 1 - 1e-4)) < 1e-9
    assert mean < got[900].prior < 0.9  # a sparse site stays near what is above it


def test_fit_separates_and_survives_one_class():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(float)
    weights, intercept = fit(x, y)
    assert np.mean((x @ weights + intercept > 0) == y) > 0.95
    assert fit(x, np.ones(500))[1] > 3 and fit(np.zeros((0, 3)), np.zeros(0)) [1] == 0


def test_edges(spark, documents, edges):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 1), (None, 1, 0), (6, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    pairs = edges + [(3, "one"), (None, "x")]
    docs = documents(pairs, source=lambda i: None if i == 2 else "s").selectExpr("*", "1 as x", "2 as good", "3 as prior", "4 as n")
    got = classify(docs, labels).collect()
    assert len(got) == len(pairs) and all(r.kept is not None and 0 < r.quality < 1 for r in got)
    none = labels.limit(0)
    assert {(r.quality, r.kept) for r in classify(docs, none).collect()} == {(0.5, True)}
    assert classify(documents([]), labels).collect() == []
