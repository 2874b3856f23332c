import math
from collections import Counter

import pytest
import xxhash
from brute import base_counts, words

from gritsieve.llm.quality_rules import quality_rules

GOOD, BAD = "the quick brown fox jumps over a lazy dog near old river banks while ", "win### cash$$$ now%%% "


def grams(text, n):
    ws = [w.encode() for w in words(text)]
    first = lambda w, seed=42: xxhash.xxh64_intdigest(w, seed=seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # Spark chains: the hash of the first word seeds the second.
    return [signed(first(w)) % n for w in ws] + [signed(first(b, first(a))) % n for a, b in zip(ws, ws[1:])]


def fold(i):
    h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % 5


def scores(pairs, trusted, n):
    """Each document by the trusted ones of the other folds."""
    raw, good = Counter(), [Counter() for _ in range(5)]
    for i, t in pairs:
        raw.update(grams(t, n))
        if i in trusted:
            good[fold(i)].update(grams(t, n))
    share = [(raw[b] + 1) / (sum(raw.values()) + n) for b in range(n)]
    out = []
    for i, t in pairs:
        others = sum((g for k, g in enumerate(good) if k != fold(i)), Counter())
        total = sum(others.values())
        weight = [math.log((others[b] + 10 * n * share[b]) / (total + 10 * n)) - math.log(share[b]) for b in range(n)]
        out.append(sum(weight[b] for b in gs) / len(gs) if (gs := grams(t, n)) else 0.0)
    return out


def cut(values):
    """From the scores of trusted documents."""
    if not values:
        return -math.inf
    n, mean = len(values), sum(values) / len(values)
    sd = math.sqrt((sum((v - mean) ** 2 for v in values) + 30 * 0.02**2) / (n + 30))
    return max(min(values) - sd, mean - (math.sqrt(2 * math.log(n)) + 1.5) * sd)


def test_against_brute_force(spark, documents, edges):
    texts = [t for _, t in edges] + [f"w{i} {GOOD * 3}" for i in range(8)] + [f"v{i} {BAD * 30}" for i in range(8)]
    texts += [f"w{i} {GOOD}" + " ".join(f"t{k}" for k in range(i, 50 + i)) for i in range(20)]
    texts += [" ".join(f"strange{k * i}" for k in range(1, 80)) for i in range(1, 9)]
    texts += [GOOD + "\n" + GOOD + "\n\n \nend", " ".join(f"u{i}" for i in range(60)) + "\nu0\nu0"]
    pairs = list(enumerate(texts))
    trusted = {i for i, t in pairs if t and t.startswith("w")}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(0, 0, 0), (1, 1, 1), (None, 1, 0), (None, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(documents(pairs), labels, buckets=50).collect()}
    found = scores(pairs, trusted, 50)
    least = cut([s for (i, t), s in zip(pairs, found) if i in trusted and len(words(t)) >= 50])
    for (i, t), s in zip(pairs, found):
        r, base = got[i], base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, t and t[:40]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r.base_failed == failed and abs(r.score - s) < 1e-9
        assert r.kept == (not failed and s >= least - 1e-9)
        assert r.text == t
    assert 0 < sum(not r.kept and not r.base_failed for r in got.values())


def test_clashing_names_repeated_rows_and_empty(spark, documents):
    docs = documents([(1, GOOD * 9), (1, GOOD * 9)]).selectExpr("*", "'x' as kept", "1 as Score", "2 as _q_words")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, none).collect()
    assert len(got) == 2 and got[0] == got[1]
    assert got[0].asDict()["kept"] == "x" and "kept_" in got[0].asDict() and "score_" in got[0].asDict()
    assert quality_rules(documents([]), none).collect() == []


def test_real_tables_separate(spark, sf):
    from gritsieve.llm.queries import op10_quality_rules

    got = op10_quality_rules(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.98
    counts = {r.doc_id: r for r in got.collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = counts[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(d.text)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_clean_documents_stay_at_every_size(spark, size):
    folder = f"/root/testdata/{size}"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    kept_ids = labels.where("doc_id % 2 = 0") if size == "sf0.01" else labels
    rows = quality_rules(docs, kept_ids).where("not base_failed").select("doc_id", "kept", "n_symbols", "n_words").collect()
    clean = [r for r in rows if 10 * r.n_symbols <= r.n_words]
    assert all(r.kept for r in clean if r.doc_id not in known)
    assert all(r.kept for r in clean if known.get(r.doc_id) == (1, 0))
    noisy = [r.kept for r in rows if 10 * r.n_symbols > r.n_words]
    assert sum(noisy) < len(noisy) and (size != "sf0.1" or sum(noisy) < 0.01 * len(noisy))


def test_a_filter_that_is_full_changes_nothing(spark, documents, monkeypatch):
    """With very few bits the filters pick nearly every id, and the joins decide."""
    from gritsieve.llm import quality_rules as module

    pairs = [(i, f"{'w' if i % 3 else 'v'}{i} {GOOD}" + " ".join(f"t{k}" for k in range(i % 7, 50))) for i in range(90)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90) if i % 3], "doc_id long, quality int, toxic int")
    whole = sorted(map(str, quality_rules(documents(pairs), labels, buckets=50).collect()))
    monkeypatch.setattr(module, "FILTER_BITS", 8)
    assert sorted(map(str, quality_rules(documents(pairs), labels, buckets=50).collect())) == whole


def test_plans_name_the_weights_and_rows_do_not_carry_them(spark, documents, capsys):
    """The driver keeps the text of every plan and of each update of it."""
    from gritsieve.llm.quality_rules import _vector, cut_of

    pairs = [(i, f"w{i} {GOOD * 5}") for i in range(9)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    weights = spark.range(10_000).selectExpr("cast(id as int) as bucket", "transform(sequence(0, 4), k -> id / 7 + k) as held")
    good = spark.createDataFrame([(i % 5, 60, [i, 9999]) for i in range(9)], "fold int, n int, grams array<int>")
    for made in (quality_rules(documents(pairs), labels).where("kept"), cut_of(good, _vector(weights))):
        made.explain(True)
        whole = capsys.readouterr().out
        assert len(whole) < 100_000
        made.explain()
        assert "_q_vector" not in capsys.readouterr().out
    numbers = spark.range(1).select(_vector(weights).alias("v")).first().v
    assert numbers == [b / 7 + k for k in range(5) for b in range(10_000)]
