import hashlib
import random

from brute import discovered, pii

from gritsieve.llm.pii import KINDS, find_personal_data, personal_data_digest


def expected(pairs):
    out = []
    for i, t in pairs:
        spans = pii(t)
        text = ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in spans)
        out.append((i, *(sum(r == n for _, r, _ in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(docs):
    return sorted((tuple(r)[:6] for r in personal_data_digest(docs).collect()), key=str)


def test_whole_table(spark, sf):
    from gritsieve.llm.queries import op8_pii

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op8_pii(spark, sf).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == expected(pairs)
    for r in got:
        base = dict(pairs)[r.doc_id]
        assert {f"{KINDS[k]}:{s}:{e}" for s, k, e in pii(base)} <= set(filter(None, r.spans.split(",")))


def test_base_spans_of_odd_texts(documents, edges):
    rng = random.Random(8)
    bits = ["a@b.c", "x", ".", "@", "-", "_", "%", "1", "23", "456", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824",
            "+", " ", "(", ")", "192.168.0.1", "256.1.1.1", "0000255.001.1.0", "é", "\U0001f600", "\n", "1.2.3.4.5.6.7.8", "5500000000000004"]
    pairs = edges + [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(600)]
    pairs += [(2000, "1 " * 30_000), (2001, "a." * 30_000 + "@"), (2002, "9" * 60_000), (2003, "+1" + "(" * 50_000), (2004, "7." * 30_000),
              (2005, "+123456789 " * 3000), (None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c")]
    docs = documents(pairs).selectExpr("*", "1 as base", "2 as value", "3 as email")
    assert digest(docs) == expected(pairs)
    assert digest(documents([])) == []


def test_contexts_discover_and_leave_the_rest(documents):
    rng = random.Random(1)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    some = lambda: " ".join(word() for _ in range(4))
    pairs = [(i, f"{some()} please call +1 {number(3)} {number(3)} {number(4)} {some()}") for i in range(20)]
    pairs += [(100 + i, f"{some()} see part {number(7)} of {some()} +1 {number(3)} {number(7)} {some()}") for i in range(20)]
    pairs += [(200, f"{some()} please call 0{number(3)} {number(4)}, {some()}"), (201, f"{some()} please call {number(2)} {some()}")]
    got = {r.doc_id: r for r in find_personal_data(documents(pairs)).collect()}
    found = {i: [s.value for s in r.added] for i, r in got.items() if r.added}
    assert list(found) == [200] and len(found[200]) == 1
    s = got[200].added[0]
    assert KINDS[s["rank"]] == "phone" and dict(pairs)[200][s.start : s.end] == s.value == found[200][0] and s.value[-1] != ","


def added(docs):
    return sorted(((r.doc_id, tuple(sorted((s.start, s["rank"], s.end, s.value) for s in r.added))) for r in find_personal_data(docs).collect()), key=str)


def test_the_bootstrap_against_brute_force(spark, sf, documents):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((i, tuple(sorted(found))) for (i, _), found in zip(pairs, discovered(pairs))), key=str)
    assert added(documents(pairs)) == want


def test_scores_travel_over_several_rounds(documents):
    """Values found in a context of seeds raise other contexts, whose values raise further ones."""
    rng = random.Random(3)
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    other = lambda: "K" + "".join(rng.choice("ABCDEF0123456789") for _ in range(19))
    shared = [other() for _ in range(6)]
    pairs = [(i, f"first token is {digest()} here") for i in range(12)] + [(20 + i, f"first token is {v} here") for i, v in enumerate(shared[:2])]
    pairs += [(40 + i, f"the hidden key {digest()} stays") for i in range(6)] + [(60 + i, f"the hidden key {v} stays") for i, v in enumerate(shared)]
    pairs += [(80 + i, f"part number {other()} of many") for i in range(6)]
    want = sorted(((i, tuple(sorted(found))) for (i, _), found in zip(pairs, discovered(pairs))), key=str)
    assert added(documents(pairs)) == want
    found = {i for i, spans in want if spans}
    assert {20, 21} <= found and not found & set(range(80, 86))


def test_secrets_beside_base_spans(spark):
    """On a larger given table contexts add spans; all that are added stand behind the word token, in any case."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [(r.doc_id, s) for r in find_personal_data(docs).where("size(added) > 0").collect() for s in r.added]
    assert spans and all("token" in texts[i][max(0, s.start - 12) : s.start].lower() for i, s in spans if KINDS[s["rank"]] == "secret")


def test_very_many_matches_in_one_text(documents):
    pairs = [(1, "a1@b.cd " * 20_000)]
    (row,) = find_personal_data(documents(pairs)).collect()
    assert [(s.start, s.end) for s in row.base] == [(8 * i, 8 * i + 7) for i in range(20_000)]
