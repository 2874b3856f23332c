"""Mixing sources to target weights by a splitting tree of hypergeometric draws, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.shared import WORD, free_name, stored

#: Production parameters: weights by rank of the source, words taken over all words, most times that a document is taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 4096
BLOCKS_PER_SHARD = 256
SEED = 17

#: Documents of one source that are summed up in one task, about.
RUN = 250


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1), fixed by the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: no (rank by code point, null last), docs, source_size, target, draw (target in whole words).

    Targets fill up like water: in rising order of size over weight, the first sources stop at `most` times their size;
    the level that the others share is the same as after resharing the excess again and again. The windows hold one row
    per source, never one per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("no", (rank - 1).cast("long")).withColumn("weight", weight)
    order = W.orderBy(F.col("source_size") / F.col("weight"), "no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) * share - capped) / open_weight)
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    cap = (F.col("source_size") * most).cast("double")
    filled = levels.withColumn("target", F.coalesce(F.least(cap, level * F.col("weight")), cap))
    return filled.select("source", "no", "docs", "source_size", "target", F.round("target").cast("long").alias("draw"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> DataFrame:
    """Every row of `docs` as id, hash of text, size and source figures, and `at`: the words before it in its source's order.

    The order is by MD5 of seed and id, so it is a fixed random permutation. Sums run in two steps, over runs of
    documents with one prefix of that MD5 and over the runs, so that a source with most of the rows is no single task.
    """
    seed = how.pop("seed", SEED)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`")
    sizes = stored(docs.select(
        own.alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit("null")))).alias("key"),
    ), "sizes")
    known = stored(sources(sizes, **how), "sources")
    most = known.agg(F.max("docs")).first()[0] or 1
    digits = max(0, math.ceil(math.log(max(most / RUN, 1), 16)))
    rows = sizes.join(known, sizes["source"].eqNullSafe(known["source"])).drop("source")
    rows = rows.withColumn("run", F.substring("key", 1, digits))
    runs = rows.groupBy("no", "run").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("no", "run", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("no", "run").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(runs, ["no", "run"]).withColumn(
        "at", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    ).select("doc_id", "text_hash", "no", "size", "source_size", "target", "draw", "at")


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` items, of `total` with `good` good ones, are good: inversion at `u`.

    Probabilities follow from their neighbours; the sums run over eight standard deviations about the mean, beyond
    which lies less than a double can tell.
    """
    g, t, n = (c.cast("double") for c in (good, total, draws))
    mean = F.when(t > 0, n * g / t).otherwise(0.0)
    spread = F.when(t > 1, F.sqrt(n * (g / t) * ((t - g) / t) * ((t - n) / (t - 1)))).otherwise(0.0)
    least, most = F.greatest(F.lit(0), draws + good - total), F.least(good, draws)
    low = F.greatest(least, F.floor(mean - 8 * spread - 4)).cast("long")
    high = F.least(most, F.ceil(mean + 8 * spread + 4)).cast("long")

    def inverted(b: Column) -> Column:
        up = lambda w, x: w * (b.g - x) * (b.n - x) / ((x + 1) * (b.t - b.g - b.n + x + 1))
        steps = F.sequence(b.low, b.high)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), b.low.alias("x"))
        summed = F.aggregate(steps, start, lambda a, x: F.struct(
            up(a.w, x).alias("w"), (a.s + a.w).alias("s"), b.low.alias("x"))).s
        found = lambda goal: F.aggregate(steps, start, lambda a, x: F.struct(
            up(a.w, x).alias("w"), (a.s + a.w).alias("s"), F.when(a.s + a.w < goal, x + 1).otherwise(a.x).alias("x"))).x
        return F.least(b.high, F.transform(F.array(summed * b.u), found)[0])

    bound = F.struct(g.alias("g"), t.alias("t"), n.alias("n"), low.alias("low"), high.alias("high"), u.alias("u"))
    return F.transform(F.array(bound), inverted)[0]


def _taker(seed: int, level: int):
    """The step of a multivariate draw: how many blocks of the next source the left child takes."""

    def take(state: Column, item: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), item.i)
        got = F.when(state.draws <= 0, F.lit(0).cast("long")).otherwise(
            _hypergeometric(item.q, state.rest, state.draws, u).cast("long"))
        return F.transform(F.array(got), lambda x: F.struct(
            (state.rest - item.q).alias("rest"), (state.draws - x).alias("draws"),
            F.concat(state.taken, F.array(x)).alias("taken")))[0]

    return take


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(shard, v): the blocks of each source in each of 2**depth shards, from one row with the quotas `v` of all sources.

    Every node gives half its blocks to its left child; how many of each source is a multivariate hypergeometric draw,
    one source after the other. Counts are exact: children add up to their parent. A row holds one number per source.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "v")
    for level in range(depth):
        if level % 8 == 7:
            nodes = nodes.repartition("shard")
        total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)

        items = F.transform("v", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        start = F.struct(F.col("n").alias("rest"), F.floor(F.col("n") / 2).alias("draws"),
                         F.array().cast("array<bigint>").alias("taken"))
        halves = nodes.select("shard", "v", F.explode(F.array(total)).alias("n")).select(
            "shard", "v", F.explode(F.array(F.aggregate(items, start, _taker(seed, level)).taken)).alias("left"))
        right = F.zip_with("v", "left", lambda a, b: a - b)
        nodes = halves.select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("v")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("v")),
        )).alias("c")).select("c.shard", "c.v")
    return nodes


def draws(
    rows: DataFrame, block_words: int = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED
) -> DataFrame:
    """The mix, one row per part of a document in a block: (doc_id, text_hash, no, at, size, shard, place, turn, first_word, n_words).

    `rows` comes from `placed`. A source's words, in permuted order and from the start again at the end, up to its draw,
    are cut in blocks. Blocks are the quota; the tree gives each shard a count of each source's blocks, the shards take
    disjoint ranges, and inside a shard blocks are shuffled by hash: `place` numbers a shard's parts. `turn` counts how
    often the document was taken before.
    """
    per_source = rows.groupBy("no").agg(F.first("draw").alias("draw")).select(
        "no", F.ceil(F.col("draw") / block_words).alias("blocks"))
    quotas = stored(per_source.agg(
        F.array_sort(F.collect_list(F.struct("no", "blocks"))).alias("q"), F.sum("blocks").alias("total")
    ).where("total > 0").select(F.transform("q", lambda x: x.blocks).alias("v"), F.transform("q", lambda x: x.no).alias("nos"), "total"), "quotas")
    total = quotas.agg(F.max("total")).first()[0] or 1
    depth = max(0, math.ceil(math.log2(total / blocks_per_shard)))
    shares = split_quotas(quotas, depth, seed).select("shard", F.posexplode("v").alias("i", "n"))
    nos = quotas.select(F.posexplode("nos").alias("i", "no"))
    until = W.partitionBy("i").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = shares.withColumn("upto", F.sum("n").over(until)).where("n > 0").join(nos, "i")
    blocks = ranges.select("no", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("block"))

    turns = rows.where("size > 0 and draw > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("draw") - 1) / F.col("source_size")))).alias("turn")
    ).withColumn("begin", F.col("turn") * F.col("source_size") + F.col("at")).withColumn(
        "end", F.least(F.col("draw"), F.col("begin") + F.col("size"))
    ).where("begin < end")
    cut = turns.select("*", F.explode(F.sequence(
        F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"))
    first = F.greatest("begin", F.col("block") * block_words)
    last = F.least("end", (F.col("block") + 1) * block_words)
    parts = cut.select("doc_id", "text_hash", "no", "at", "size", "turn", "block", (first - F.col("begin")).alias("first_word"),
                       (last - first).alias("n_words"), first.alias("stream"))
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "no", "block"), "no", "block", "stream")
    return parts.join(blocks, ["no", "block"]).withColumn("place", F.row_number().over(shuffled)).drop("stream", "block")


def taken(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """`rows` of `placed` with `taken`: the words the mix takes of each. A place in a source's order names a document."""
    sums = drawn.groupBy("no", "at").agg(F.sum("n_words").alias("taken"))
    with_words = rows.where("size > 0").join(sums, ["no", "at"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return with_words.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, text_hash) for every row of `docs`.

    Sources weigh 5, 2, 1, and so on, by code point, null last, and share 1.5 times all words; none is taken over twice. A
    source gives its target rounded to whole words; only the last document of its draw is taken in part. A null, empty
    or blank text has size 0 and nothing taken. Rows with equal ids are ordered by size and text; equal rows are
    interchangeable. An empty table gives an empty one.
    """
    rows = stored(placed(docs, id_col, text_col, source_col, **how), "placed")
    return taken(rows, draws(rows, seed=how.get("seed", SEED))).select(
        "doc_id", "size", "source_size", "target", "taken", "text_hash"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of `docs`: each document as often as it is taken whole, then its first words if it is taken in part.

    Those words are joined by single spaces. Equal rows are told apart by counting them.
    """
    h, n, nth, whole, part = (free_name(docs, c) for c in ("_m_hash", "_m_taken", "_m_nth", "_m_whole", "_m_part"))
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = ["_null", "_id", "_hash"]
    counts = mix_counts(docs, id_col, text_col, source_col, **how).where("taken > 0")
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    counts = counts.select(
        F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", zero).alias("_id"), F.col("text_hash").alias("_hash"),
        F.col("taken").alias(n), F.col("size").alias(whole))
    counts = counts.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(n))))
    rows = docs.withColumns({h: F.xxhash64(text), nth: F.lit(0)})
    rows = rows.withColumn(nth, F.row_number().over(W.partitionBy(own.isNull(), F.coalesce(own, zero), h).orderBy(h)))
    joined = rows.join(counts, (own.isNull() == F.col("_null")) & (F.coalesce(own, zero) == F.col("_id"))
                       & (F.col(h) == F.col("_hash")) & (F.col(nth) == F.col("_nth")))
    ws = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = (F.col(n) % F.col(whole)).cast("int")
    copies = F.concat(
        F.array_repeat(text, F.floor(F.col(n) / F.col(whole)).cast("int")),
        F.when(rest > 0, F.array(F.array_join(F.slice(ws, F.lit(1), rest), " "))).otherwise(F.array().cast("array<string>")),
    )
    out = joined.select("*", F.explode(copies).alias(part))
    return out.select(*(F.col(part).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
