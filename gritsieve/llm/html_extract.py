"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of one host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.html_tree import LISTED, Node, Page, fold, loosen, merge, MOST_ITEMS, packed, unpacked
from gritsieve.llm.shared import discard, stored
from gritsieve.operators.ranks import lookup

#: Wrappers of one host merged in one group, about.
TOGETHER = 64
#: Without an element that says where the article is: share of a container's text that leads into one of its parts, share of
#: linked words from which a slot is a menu, and pages from which a text that never changes is part of the template.
MOST_OF_IT = 0.6
LINKED = 0.5
ALWAYS = 3

_HOST = re.compile(r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().rstrip(".") if found else ""


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page with its host, the shape of its folded tree, its texts with their slots, and figures of each slot."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url"), batch.column("html")):
                tree, blocks, figures = Page(page.as_py() or "").shape()
                shape = json.dumps(tree, separators=(",", ":"), ensure_ascii=False)
                rows.append((host_of(url.as_py()), xxhash.xxh64_intdigest(shape) >> 1, shape, [n for n, _ in blocks], [t for _, t in blocks],
                             [f[0] for f in figures], [f[1] for f in figures], [f[2] for f in figures]))
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("page_id", "url")},
                **{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_PARSED.items())},
            })

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(parse, (
        f"page_id {kind}, url string, host string, shape_id long, shape string, slots array<int>, texts array<string>, "
        "words array<long>, links array<long>, hashes array<long>"))


_PARSED = {
    "host": pa.string(), "shape_id": pa.int64(), "shape": pa.string(), "slots": pa.list_(pa.int32()), "texts": pa.list_(pa.string()),
    "words": pa.list_(pa.int64()), "links": pa.list_(pa.int64()), "hashes": pa.list_(pa.int64()),
}


def shapes_of(parsed: DataFrame) -> DataFrame:
    """(host, shape_id, shape, figures): each distinct tree of a host once, with the figures of its slots over its pages:
    pages, words, linked words, and the hash of a text that is the same on all of them, else null."""
    key = ["host", "shape_id"]
    shapes = parsed.groupBy(*key).agg(F.min("shape").alias("shape"), (F.min("shape") == F.max("shape")).alias("one"))
    zipped = F.arrays_zip("words", "links", "hashes")
    slots = parsed.select(*key, F.posexplode(zipped).alias("slot", "z")).groupBy(*key, "slot").agg(
        F.count("*").alias("pages"), F.sum("z.words").alias("words"), F.sum("z.links").alias("links"),
        F.when(F.min("z.hashes") == F.max("z.hashes"), F.min("z.hashes")).alias("same"),
    )
    figures = slots.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("slot", "pages", "words", "links", "same"))).alias("figures"))
    out = stored(shapes.join(figures, key, "left"), "shapes")
    if out.where("not one").limit(1).count():
        raise RuntimeError("two shapes share a hash")
    return out.drop("one")


def _wrapper(data: str) -> Node:
    """A tree with its figures, from `_written`."""
    tree, figures = json.loads(data)
    root = unpacked(tree)
    for slot, (pages, words, links, same) in zip(root.slots(), figures):
        slot.pages, slot.words, slot.links, slot.same = pages, words, links, same
    return root


def _written(root: Node) -> str:
    figures = [[s.pages, s.words, s.links, s.same] for s in root.slots()]
    return json.dumps([packed(root), figures], separators=(",", ":"), ensure_ascii=False)


def _first_wrappers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, shape, figures in zip(batch["host"], batch["shape"], batch["figures"]):
            rows = [] if figures is None else [[f["pages"], f["words"], f["links"], f["same"]] for f in figures]
            out.append((host, json.dumps([json.loads(shape), rows], separators=(",", ":"), ensure_ascii=False)))
        yield pd.DataFrame(out, columns=["host", "wrapper"])


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of a group, one after the other, into one: aligned as in `merge`."""
    first, *others = sorted(group["wrapper"])
    root = _wrapper(first)
    for data in others:
        merge(root, _wrapper(data))
    root.items = fold(root.items)
    if len(root.items) > MOST_ITEMS:
        loosen(root)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_written(root)]})


def host_wrappers(shapes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(host, wrapper): one wrapper for each host, merged in rounds of groups of about `together`, dealt by hash.

    A host with very many shapes is many groups in a round, so no task merges a host alone; a round leaves at most one
    wrapper per group.
    """
    figures = shapes.select("host", "shape", "figures")
    current = stored(figures.mapInPandas(_first_wrappers, "host string, wrapper string"), "wrappers")
    while True:
        sizes = stored(current.groupBy("host").agg(F.count("*").alias("n")), "sizes")
        if sizes.where("n > 1").limit(1).count() == 0:
            return current
        groups = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / together))
        dealt = lookup(current, sizes, ["host"], "inner").select("host", "wrapper", groups.alias("group"))
        after = stored(dealt.groupBy("host", "group").applyInPandas(_merged, "host string, wrapper string"), "wrappers")
        discard(current)
        current = after


def _in_main(node: Node, inside: bool, noise: bool, out: dict[int, tuple[bool, bool]]) -> bool:
    """For each slot, by id, whether it lies in an article or main element and whether in noise; tells if any is in one.

    An element that looks like noise but holds the article is none.
    """
    inside_here = inside or "*" in node.label
    if node.label == "#":
        out[id(node)] = (inside, noise)
        return inside and not noise
    own: dict[int, tuple[bool, bool]] = {}
    marked = "!" in node.label
    found = [_in_main(item, inside_here, noise or (marked and "*" in node.label), own) for item in node.items]
    has = any(found)
    if marked and "*" not in node.label and (inside or not has):
        own = {k: (i, True) for k, (i, _) in own.items()}
        has = False
    out.update(own)
    return has


def decide(root: Node) -> dict[int, tuple[bool, bool]]:
    """For each slot of a wrapper, by id: whether it is main text on pages that have an article element, and on others.

    With one, its slots that are no noise; within main, those of an article if they hold half the words. On other
    pages the way leads from the root into the container that holds most of the running text; there, texts that never
    change on three pages or more and lists of links are left out.
    """
    where: dict[int, tuple[bool, bool]] = {}
    _in_main(root, False, False, where)
    slots = list(root.slots())
    articles: dict[int, tuple[bool, bool]] = {}
    _articles(root, False, articles)
    named = {id(s): where[id(s)][0] and not where[id(s)][1] for s in slots}
    total = sum(s.words for s in slots if named[id(s)])
    if 2 * sum(s.words for s in slots if named[id(s)] and articles[id(s)]) >= total:
        named = {k: v and articles[k] for k, v in named.items()} if any(articles[k] for k, v in named.items() if v) else named
    varied = any(s.same is None or s.pages < ALWAYS for s in slots)

    def running(s: Node) -> bool:
        template = varied and s.pages >= ALWAYS and s.same is not None
        return not where[id(s)][1] and not template and s.links < LINKED * max(1, s.words)

    container = root
    while True:
        weights = [(sum(s.words for s in item.slots() if running(s)), n) for n, item in enumerate(container.items)]
        whole = sum(w for w, _ in weights)
        best = max(weights, key=lambda w: (w[0], -w[1]), default=(0, 0))
        if not whole or best[0] < MOST_OF_IT * whole or container.items[best[1]].label.split(".")[0] in _LEAVES:
            break
        container = container.items[best[1]]
    within = {id(s) for s in container.slots() if running(s)}
    return {id(s): (named[id(s)], id(s) in within) for s in slots}


_LEAVES = LISTED | frozenset("h1 ul ol dl table tr pre #".split())


def _articles(node: Node, inside: bool, out: dict[int, bool]) -> None:
    if node.label == "#":
        out[id(node)] = inside
    inside = inside or node.label.startswith("article*")
    for item in node.items:
        _articles(item, inside, out)


def _match(shape: Node, wrapper: Node, decided: dict[int, tuple[bool, bool]], out: list[tuple[bool, bool]]) -> None:
    """The decisions for the slots of a page's tree in order, found by walking it along its host's wrapper."""
    if shape.label == "#":
        out.append(decided[id(wrapper)])
        return
    at = 0
    for item in shape.items:
        ahead = [n for n in range(at, len(wrapper.items)) if wrapper.items[n].label == item.label]
        found = ahead or [n for n, w in enumerate(wrapper.items) if w.label == item.label]
        at = found[0]
        _match(item, wrapper.items[at], decided, out)
        if not wrapper.items[at].rep:
            at += 1


@lru_cache(maxsize=64)
def _decided(wrapper: str) -> tuple[Node, dict[int, tuple[bool, bool]]]:
    root = _wrapper(wrapper)
    return root, decide(root)


def kept_slots(shape: str, wrapper: str) -> list[bool]:
    """For each slot of a page's shape whether its host's wrapper takes it for main text."""
    root, decided = _decided(wrapper)
    page = unpacked(json.loads(shape))
    where: dict[int, tuple[bool, bool]] = {}
    has_main = _in_main(page, False, False, where) or _has_main(page)
    out: list[tuple[bool, bool]] = []
    _match(page, root, decided, out)
    return [named if has_main else other for named, other in out]


def _has_main(node: Node) -> bool:
    return ("*" in node.label and "!" not in node.label) or any(_has_main(i) for i in node.items)


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["keep"] = [kept_slots(s, w) for s, w in zip(batch["shape"], batch["wrapper"])]
        yield batch[["host", "shape_id", "keep"]]


def main_texts(pages: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, one a line.

    Pages are folded to trees; the distinct trees of a host are merged into its wrapper; the wrapper's slots are judged by
    what all pages of the host put there, and a page's text is what stands in slots judged main text. Null or empty html
    gives an empty text; pages without a host in their url form one group; repeated rows stay and get equal texts; other
    columns are ignored; an empty table gives an empty one.
    """
    parsed = stored(parsed_pages(pages), "pages")
    shapes = shapes_of(parsed)
    wrappers = host_wrappers(shapes, together)
    known = lookup(shapes.select("host", "shape_id", "shape"), wrappers, ["host"], "inner")
    known = stored(known.mapInPandas(_kept, "host string, shape_id long, keep array<boolean>"), "kept")
    rows = lookup(parsed.select("page_id", "url", "host", "shape_id", "slots", "texts"), known, ["host", "shape_id"], "inner")
    chosen = F.filter(F.arrays_zip("slots", "texts"), lambda b: F.get("keep", b.slots))
    text = F.array_join(F.transform(chosen, lambda b: b.texts), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
