import html
import random
import re

import pytest

from gritsieve.llm.html_extract import host_of, host_wrappers, main_texts, parsed_pages, shapes_of, _wrapper
from gritsieve.llm.html_tree import Node, Page, align, expression, fold, packed, unpacked
from gritsieve.llm.queries import op12_html

SCHEMA = "page_id long, url string, html string"


def article_blocks(page):
    """The article of a given page without any tree: cut at p and h1 tags."""
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(b for b in blocks if b)


def texts(spark, pages, **how):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    return {r.page_id: r.text for r in main_texts(df, **how).collect()}


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = op12_html(spark, sf).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {
        (r.page_id, r.url, (t := article_blocks(r.html)), len(t)) for r in rows}
    assert len(got) == len(rows)


PAGE = """<!doctype html><html><head><title>T</title><meta name=x content='<p>no</p>'><style>p{{}}</style>
<script>if (a < b) document.write("</p><article>no</article>")</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><!-- <p>comment</p> -->
<main><article class="post-content no-sidebar"><header><h1>Title&nbsp;{i}</h1></header>
<p>First &amp; &lt;b&gt; <b>bold</b> <a href=x>link</a> text
   of {i}<p>Second<br>line <span class="ad">buy</span>here<ul><li>one<li>two</ul>
<div class="ad-slot"><p>Advert {i}</p></div><table><tr><td>a<td>b<tr><td>c</table>
<form><label>Mail</label><input value="q"><button>Send</button></form><aside>Aside {i}</aside>
<footer>By someone</footer></article>
<section id="comments"><article class="comment"><p>Reader {i} says</p></article></section></main>
<div class="sidebar"><p>Side text that is quite long, longer than the article would be if it were short {i}</p></div>
<footer>&copy; {i}</footer></body></html>"""
TEXT = "Title {i}\nFirst & <b> bold link text of {i}\nSecond line here\none\ntwo\na\nb\nc"


def test_everything_but_the_article_goes(spark):
    got = texts(spark, [(i, f"https://u@Site.example:8080/{i}", PAGE.format(i=i)) for i in range(5)])
    assert got == {i: TEXT.format(i=i) for i in range(5)}


def story(i, n=4):
    rng = random.Random(i)
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(n + i % 3)]


def test_a_host_without_article_elements(spark):
    """Plain divs: the wrapper tells the template's texts and menus from the running text."""
    pages = []
    for i in range(12):
        menu = "".join(f"<li><a href='/{k}'>entry {k}</a></li>" for k in range(3 + i % 2))
        banner = "<div class='x'>Sale this week only</div>" if i % 2 else ""
        body = "".join(f"<p>{p}</p>" for p in story(i))
        pages.append((i, "http://plain.example/", (
            f"<body><div class='top'><ul>{menu}</ul></div>{banner}<div class='wrap'><div class='inner'><h2>Story {i}</h2>{body}"
            f"<div class='after'>Tell your friends about it</div></div></div><div class='end'>All rights reserved</div></body>")))
    got = texts(spark, pages)
    assert got == {i: "\n".join([f"Story {i}", *story(i)]) for i in range(12)}


def test_broken_markup_and_edges(spark):
    pages = [
        (1, None, None), (2, None, ""), (3, "x", "just text &amp more"), (4, "http://a.example", "<article><p>one<p>two"),
        (5, "http://a.example", "<article><p>a < b</p></div></p><p>c</article></article><p>after"),
        (6, "http://a.example", "<article><p>cut <a href='x"), (7, "http://b.example", "<article>" + "<div>" * 5000 + "deep"),
        (8, "http://b.example", "<article>" + "<p>w</p>" * 20_000), (9, "http://b.example", "<script>never closed <article><p>x"),
        (10, "http://c.example", "<article><p>x<!-- open <p>y"), (None, "http://c.example", "<article><p>no id</article>"),
        (11, "http://c.example", "<article></article>"), (11, "http://c.example", "<article></article>"),
    ]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], SCHEMA + ", text string, host int").repartition(4)
    got = sorted((r.page_id or 0, r.text) for r in main_texts(df).collect())
    assert got == [
        (0, "no id"), (1, ""), (2, ""), (3, "just text & more"), (4, "one\ntwo"), (5, "a < b\nc"), (6, "cut"), (7, "deep"),
        (8, "\n".join(["w"] * 20_000)), (9, ""), (10, "x"), (11, ""), (11, ""),
    ]


def test_empty(spark):
    assert main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def random_page(rng, i):
    parts = []
    for _ in range(rng.randint(1, 12)):
        kind = rng.choice("pphult")
        word = lambda: f"{rng.choice(['red', 'blue'])}{rng.randint(0, 999)} text"
        parts.append({
            "p": f"<p>{word()}</p>", "h": f"<h2>{word()}</h2>", "u": f"<ul><li>{word()}</li><li>{word()}</li></ul>",
            "l": f"<div class=ad>{word()}</div>", "t": f"<blockquote><p>{word()}</p></blockquote>",
        }[kind])
    want = [x for part in parts if "class=ad" not in part for x in re.findall(r">([^<>]+)<", part)]
    return f"<body><nav><a>m</a></nav><article>{''.join(parts)}</article><footer>f{i}</footer>", "\n".join(want)


@pytest.mark.parametrize("together", [64, 2])
def test_one_host_of_many_shapes(spark, together):
    rng = random.Random(4)
    pages, want = [], {}
    for i in range(300):
        page, want[i] = random_page(rng, i)
        pages.append((i, f"http://{'hot' if i % 3 else 'cold'}.example/{i}", page))
    assert texts(spark, pages, together=together) == want


def test_wrappers_have_slots_options_and_repeats(spark):
    pages = [
        (1, "http://r.example", "<div><h1>A</h1><p>x</p><dl><dt>a<dd>b<dt>c<dd>d</dl></div>"),
        (2, "http://r.example", "<div><h1>B</h1><p>y</p><p>z</p><img><table><tr><td>t</table><dl><dt>a<dd>b</dl></div>"),
    ]
    shapes = shapes_of(parsed_pages(spark.createDataFrame(pages, SCHEMA)))
    (row,) = host_wrappers(shapes).collect()
    assert expression(_wrapper(row.wrapper)) == (
        "<page><div><h1>#</> <p>#</>+ <table><tr><td>#</></></>? <dl>(<dt>#</>+ <dd>#</>+)+</></></>")


def leaf(label):
    node = Node(label)
    node.items = [Node("#")]
    return node


def accepts(node, labels):
    pattern = "".join(f"(?:{i.label},)" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[i.opt, i.rep] for i in node)
    return re.fullmatch(pattern, "".join(f"{x}," for x in labels)) is not None


def test_aligned_sequences_accept_both():
    rng = random.Random(9)
    for _ in range(300):
        x, y = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert accepts(align([leaf(c) for c in x], [leaf(c) for c in y]), x)
        assert accepts(align([leaf(c) for c in x], [leaf(c) for c in y]), y)


def test_folding_keeps_every_block():
    page = Page("<ul><li>a<li><b>b</b> c<li>d<p>e</ul><p>f<p>g<div>h</div><div>i</div>")
    tree, blocks, figures = page.shape()
    assert [t for _, t in blocks] == ["a", "b c", "d", "e", "f", "g", "h", "i"]
    assert sum(f[0] for f in figures) == 9 and packed(unpacked(tree)) == tree
    assert len(fold([leaf("p") for _ in range(9)])) == 1


def test_hosts():
    assert [host_of(u) for u in ("HTTP://WWW.a.example.:80/x", "https://[::1]:2/", None, "no url", "//a/b")] == ["www.a.example", "[::1]", "", "", ""]
