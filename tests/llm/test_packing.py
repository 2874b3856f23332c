import random
import zlib
from array import array

import public_tokenizers
from brute import words
from tokenizers import Tokenizer

from gritsieve.llm import packing
from gritsieve.llm.packing import WordIds, _texts_ids, fullest, pack, plan_bins, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pairs, got, capacity=4096):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text in pairs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = array("I", ids[start : start + capacity])
            want.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in got) // capacity)


def test_whole_table(spark, sf):
    from gritsieve.llm.queries import op1_packing

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(pairs, op1_packing(spark, sf).collect())
    assert used <= least + 1


def test_edges_and_clashing_names(documents, edges):
    pairs = edges + [(None, "x"), (3, "one"), (3, "one")] + [(90, "a " * 4095), (91, "a " * 4096), (92, "a " * 8191)]
    docs = documents(pairs).selectExpr("*", "1 as length", "2 as offset", "3 as rank", "4 as run")
    check(pairs, pack(docs, PATH).collect())
    check(pairs, pack(docs, PATH, capacity=7).collect(), 7)
    assert pack(documents([]), PATH).collect() == []


def test_ids_of_odd_texts():
    rng = random.Random(2)
    bits = ["Ab", "ß", ".", ",", "'s", "'", "é", "é", "H̱", "İ", "Σ", " ", "　", "\x1c", "\x85", " ", "\n", "7",
            "<|endoftext|>", "<|", "|>", "ENDOFTEXT", "日本", "\U0001f600", "#*", "ﬁ", "K", "ͅ", "ÀÉ", "x.y,z", "ªº"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    tokenizer, ids = Tokenizer.from_file(PATH), WordIds(PATH)
    for text, parts in zip(texts, _texts_ids([t.encode() for t in texts], ids)):
        assert array("I", b"".join(parts)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_and_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 1000)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    text = " ".join(f"w{i}x" for i in range(3000))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    got = [array("I", b"".join(p)).tolist() for p in _texts_ids([b"a", text.encode(), b"b c"], WordIds(PATH))]
    assert got[1] == want and len(got) == 3
    assert len(words(text)) == 3000


def test_fullest_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        used = fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 4096): rng.randint(1, 500) for _ in range(800)}
    plan = plan_bins(counts, 4096)
    used = {}
    for bins, pattern in plan:
        assert sum(k * n for k, n in pattern.items()) <= 4096
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + bins * n
    assert used == counts and len(plan) <= 2 * len(counts)


def test_sequences_hold_the_ids(documents):
    docs = documents([(i, "some words here " * i) for i in range(40)])
    rows = pack(docs, PATH, capacity=64, with_ids=True)
    tokenizer = Tokenizer.from_file(PATH)
    flat = {r.sequence_id: r.ids for r in sequences(rows).collect()}
    for r in rows.collect():
        ids = [*tokenizer.encode("some words here " * r.doc_id, add_special_tokens=False).ids, 1]
        assert flat[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]
