import random

from gritsieve.llm.licenses import _WORD, TEMPLATES, Templates, license_scan, scan_text

T = Templates(TEMPLATES)
FILL = "thor inge and the bleed of onty"


def filler(rng, n):
    return " ".join(rng.choices(FILL.split(), k=n))


def names(text):
    return [(f[0], text[f[1] : f[2]]) for f in scan_text(text, T)]


def flat(text):
    return " ".join(text.split())


def test_every_template_is_found_whole_and_alone():
    rng = random.Random(1)
    for name, text in TEMPLATES.items():
        found = scan_text(f"{filler(rng, 300)}\n{flat(text)}\n{filler(rng, 300)}", T)
        assert [f[0] for f in found] == [name], name
        assert found[0][5:] == ([], [])
        assert name in [x[1] for x in T.ranked([w.lower() for w in _WORD.findall(text)])[1][:2]]


def test_differences_are_named_and_too_many_reject():
    text = flat(TEMPLATES["MIT"])
    found = scan_text(text.replace("free of charge", "free of any charge").replace("merge, ", ""), T)
    assert [(f[0], f[5], f[6]) for f in found] == [("MIT", ["merge"], ["any"])]
    assert scan_text("All right is reserved under the license of the town", T) == []
    assert scan_text("released under the law of the land, with license", T) == []


def test_several_in_one_text_and_wrapped_lines():
    rng = random.Random(2)
    chosen = ["MIT", "No license", "Apache-2.0 notice", "GPL-3.0-or-later", "GPL-2.0-or-later", "CC-BY-SA-4.0"]
    text = "\n".join(f"{filler(rng, 40)}\n" + "\n * ".join(TEMPLATES[n].split("\n")) for n in chosen)
    assert [n for n, _ in names(text)] == chosen
    many = "\n".join([TEMPLATES["No license"]] * 3000 + [flat(TEMPLATES["MIT"])])
    assert [n for n, _ in names(many)] == ["No license"] * 3000 + ["MIT"]


def test_whole_table(spark, sf):
    from gritsieve.llm.queries import op6_licenses

    notices = [k for k in TEMPLATES if "notice" in k or k == "No license"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((d.doc_id, n, d.text.index(TEMPLATES[n])) for d in docs for n in notices if TEMPLATES[n] in d.text)
    assert sorted((r.doc_id, r.license, r.start) for r in op6_licenses(spark, sf).collect()) == want


def test_edges(documents, edges):
    pairs = edges + [(50, TEMPLATES["No license"]), (50, TEMPLATES["No license"]), (None, "ALL RIGHTS\n RESERVED"), (60, "license " * 20_000)]
    docs = documents(pairs).selectExpr("*", "1 as license", "2 as start")
    assert sorted(((r.doc_id, r.license) for r in license_scan(docs).collect()), key=str) == [
        (50, "No license"), (50, "No license"), (None, "No license")]
    assert license_scan(documents([])).collect() == []


def test_a_quote_does_not_hide_an_edited_license():
    rng = random.Random(3)
    text = flat(TEMPLATES["MIT"]).split()
    for changed, quoted in ((8, 20), (3, 30)):
        edited = list(text)
        for k in range(changed):
            edited[(2 * k + 1) * len(text) // (2 * changed)] = f"changed{k}"
        alone = scan_text(" ".join(edited), T)
        assert [f[0] for f in alone] == ["MIT"]
        for quote in (text[:quoted], text[-quoted:]):
            for whole in (f"{' '.join(quote)} {filler(rng, 60)} {' '.join(edited)}", f"{' '.join(edited)} {filler(rng, 60)} {' '.join(quote)}"):
                found = scan_text(whole, T)
                assert [(f[0], len(f[5])) for f in found] == [("MIT", len(alone[0][5]))]
