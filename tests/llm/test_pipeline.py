import random

import corpus_pipeline
from brute import repeated_runs, simhash, words

from gritsieve.llm.simhash import one_of_each_group


def test_one_of_each_group(documents):
    pairs = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, None), (None, ""), (None, "z z"), (None, "z z"),
             (7, "q r s t u")]
    docs = documents(pairs).selectExpr("*", "1 as fp", "2 as component", "3 as _s_id")
    got = sorted(((r.doc_id, r.text) for r in one_of_each_group(docs).collect()), key=str)
    assert got == [(1, "a b c d"), (5, None), (7, "q r s t u"), (None, "z z")]
    assert one_of_each_group(documents([])).collect() == []


def test_stages(spark, documents, tmp_path):
    rng = random.Random(9)
    line = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    passage = line(60)
    docs = [(i, "\n".join([line(30), line(40), line(20)])) for i in range(60)]
    docs += [(60 + i, f"{line(50)}\n{passage}\n{line(30)}") for i in range(5)]
    docs += [(70, docs[3][1]), (71, docs[4][1]), (72, "too short"), (73, None), (74, "go " * 200)]
    near = docs[10][1].split(" ")
    near[45] = "changed"
    docs.append((80, " ".join(near)))
    documents(docs, source=lambda i: f"s{i % 4}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in docs if i not in (72, 73, 74)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {n: {r.doc_id: r.text for r in rows} for n, rows in seen.items() if n != "packing"}
    assert set(texts["quality_rules"]) == {i for i, _ in docs} - {72, 73, 74}
    order = sorted(texts["quality_rules"].items())
    cut = repeated_runs(order, 50)
    for k, (i, text) in enumerate(order):
        if not cut[k]:
            assert texts["line_dedup"][i] == text
    assert 70 not in texts["line_dedup"] and sum(passage in t for t in texts["line_dedup"].values()) == 1
    assert 60 in texts["line_dedup"] and passage in texts["line_dedup"][60]
    prints = {i: simhash(t) for i, t in texts["line_dedup"].items()}
    kept = set(texts["simhash"])
    for i in prints:
        assert i in kept or any((prints[i] ^ prints[j]).bit_count() <= 3 for j in prints if j < i)
    sizes, taken = {i: len(words(t)) for i, t in texts["simhash"].items()}, {}
    for r in seen["mixing"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 4
    assert len([r for r in seen["packing"] if r.piece == 0]) == len(seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_stages_take_edges_and_nulls(spark, documents, edges, tmp_path):
    rng = random.Random(4)
    some = lambda: " ".join(f"v{rng.randrange(9000)}" for _ in range(90))
    rows = [(i, t, None, None, None) for i, t in edges]
    rows += [(None, some(), "en", "a", 3), (50, some(), None, None, None), (51, some(), "de", "b", None)]
    copy = some()
    rows += [(60, copy, "en", "a", 1), (60, copy, "en", "a", 1), (61, copy, None, None, 1), (None, copy, "en", "é", 1), (62, "x " * 30_000, "", "", 0)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, documents([]).schema).selectExpr("*").repartition(3)
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            path = tmp_path / f"{name}-{table is docs}"
            out.write.parquet(str(path))
            now = spark.read.parquet(str(path))
            if name == "simhash" and table is docs:
                texts = [r.text for r in now.collect()]
                assert len(texts) == 4 and texts.count(copy) == 1
        assert (now.count() > 0) == (table is docs)
