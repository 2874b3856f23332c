import random

from brute import repeated_runs, words

from gritsieve.llm.line_dedup import line_dedup


def check(docs, pairs, low=20, high=50):
    """All that goes is repeated; of what is repeated, under `high` words in a row may stay (parts from several places)."""
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    must, may = repeated_runs(pairs, high), repeated_runs(pairs, low)
    missed = 0
    for k, (i, text) in enumerate(pairs):
        r, lines = got[i], text.split("\n")
        kept = r.text.split("\n") if r.n_cut < len(lines) else []
        assert r.n_lines == len(lines) == len(kept) + r.n_cut and r.n_cut <= len(may[k])
        rest = iter(kept)
        assert all(any(x == y for y in rest) for p, x in enumerate(lines) if p not in may[k])
        stays = [p for p in sorted(must[k]) if lines[p] in kept and lines.count(lines[p]) == 1]
        missed += len(stays)
        for at, p in enumerate(stays):
            run = 0
            for n, q in enumerate(stays[at:]):
                if q != p + n:
                    break
                run += len(words(lines[q]))
            assert run < high
    return missed, sum(map(len, must.values()))


def random_docs(seed, n=40):
    rng = random.Random(seed)
    line = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passages = ["\n".join(line(rng.randint(4, 30)) for _ in range(rng.randint(3, 9))) for _ in range(4)] + [line(55)]
    passages = [p for p in passages if len(words(p)) > 50]
    out = []
    for i in range(n):
        parts = [line(rng.randint(3, 40)) for _ in range(rng.randint(2, 6))] + ["", "  "]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        if out and rng.random() < 0.15:
            parts = rng.choice(out)[1].split("\n")
        if rng.random() < 0.3:
            parts.insert(0, "a boilerplate line of few words")
        out.append((i, "\n".join(parts)))
    return out


def test_planted_passages(documents):
    for seed in (1, 2):
        pairs = random_docs(seed)
        missed, repeated = check(documents(pairs), pairs)
        assert missed < 0.05 * repeated


def test_runs_within_one_document_and_edges(documents, edges):
    long_line = " ".join(f"q{i}" for i in range(60))
    pairs = edges + [(100, f"{long_line}\nx\n{long_line}\n  {long_line} \ny"), (101, "\n".join(["ab cd ef gh"] * 200))]
    docs = documents(pairs)
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert got[100].text == f"{long_line}\nx\ny" and got[100].n_cut == 2
    assert got[101].n_cut == 199 and got[101].text == "ab cd ef gh"
    for i, t in edges:
        assert got[i].text == t


def test_short_repeats_stay_and_first_place_keeps(documents):
    passage = " ".join(f"p{i}" for i in range(51))
    got = {r.doc_id: r.text for r in line_dedup(documents([(2, f"short line\n{passage}"), (1, f"{passage}\nshort line")])).collect()}
    assert got == {1: f"{passage}\nshort line", 2: "short line"}


def test_null_ids_repeated_rows_and_clashing_names(spark, documents):
    passage = " ".join(f"p{i}" for i in range(51))
    docs = documents([(None, passage), (7, passage), (7, passage)]).selectExpr("*", "1 as n_cut", "2 as pos", "3 as gram")
    got = sorted(((r.doc_id, r.text, r.n_cut_) for r in line_dedup(docs).collect()), key=str)
    assert got == [(7, passage, 0), (7, passage, 0), (None, "", 1)]
    assert line_dedup(documents([])).collect() == []


def test_parts_that_stand_earlier_in_other_surroundings(documents):
    rng = random.Random(5)
    line = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    pairs = []
    for k in range(12):
        a, b, c = line(20), line(25), line(20)
        pairs += [(10 * k, f"{line(30)}\n{b}\n{line(30)}"), (10 * k + 1, f"{a}\n{line(40)}"), (10 * k + 2, f"{line(9)}\n{a}\n{b}\n{c}"),
                  (10 * k + 3, f"{a}\n{b}\n{c}\n{line(7)}"), (10 * k + 4, f"{line(8)}\n{a}\n{b}\n{c}\n{line(5)}")]
    missed, repeated = check(documents(pairs), pairs)
    assert missed == 0 and repeated >= 72
    mixed = random_docs(3, 60)
    assert check(documents(mixed), mixed)[0] == 0
