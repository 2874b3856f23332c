import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gritsieve.llm.queries import op11_spelling
from gritsieve.llm.spelling import LETTERS, _by_length, _keys, near_words, neighbour_keys, spelling_variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def counted(pairs):
    out = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def expected(pairs):
    n = counted(pairs)
    meet = defaultdict(list)
    for w in n:
        for key in {w[:i] + "*" + w[i + 1:] for i in range(len(w))} | {w[:i] + "*" + w[i:] for i in range(len(w) + 1)}:
            meet[key].append(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_whole_table(spark, sf):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op11_spelling(spark, sf).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(pairs)


def test_edges_nulls_repeats_and_clashing_names(spark, edges):
    texts = ["Variant variant " * 30, "variamt varient variamt", "VARIANT variänt variänt", "Étudiant étudiant Étudiant"]
    texts += ["variamtt variamtt ", "q" * 5000 + " " + "q" * 5000, "q" * 4999 + "z " + "q" * 4999 + "z"]
    pairs = edges + list(enumerate(texts * 2)) + [(None, texts[0]), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], "doc_id long, text string, word string, n int")
    got = spelling_variants(docs).collect()
    assert {tuple(r) for r in got} == expected(pairs)


def test_empty(documents):
    assert spelling_variants(documents([])).collect() == []


def test_chains_lead_to_the_last_form(documents):
    pairs = [(1, "abcdefgh " * 500 + "abcdefgx " * 40 + "abcdefyx " * 3)]
    rows = {r.word: r for r in spelling_variants(documents(pairs)).collect()}
    assert rows["abcdefyx"].form == "abcdefgx" and rows["abcdefyx"].root == rows["abcdefgx"].root == rows["abcdefgx"].form == "abcdefgh"
    assert {tuple(r) for r in rows.values()} == expected(pairs)


@pytest.mark.parametrize("most", [1, 5])
def test_finer_alphabets_find_the_same(spark, sf, most):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = counted(pairs)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: r.n_near for r in near_words(words, most=most).collect()}
    assert got == {w: k for w, _, _, _, k, _ in expected(pairs) if k}


def test_neighbour_keys_are_those_of_all_edits():
    for word, alphabet in (("abca", 3), ("a", 4), ("zÿ" * 4, len(LETTERS))):
        letters = LETTERS[:alphabet]
        edits = {word} | {word[:i] + word[i + 1:] for i in range(len(word))}
        edits |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
        edits |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        keys = {int(k) for e in edits if e for _, s in _by_length([e]) for k in _keys(s)} | ({0} if "" in edits else set())
        ((_, symbols),) = _by_length([word])
        got = np.concatenate([k for _, k in neighbour_keys(symbols, alphabet)])
        assert set(map(int, got)) == keys
