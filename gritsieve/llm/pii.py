"""Personal data: fixed patterns, and contextual patterns bootstrapped from what those find; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.shared import stored, with_computed

#: Kinds in the order in which spans at one place are listed. `secret` has no base pattern: only contexts find its spans.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

#: The base patterns, in a form that runs in linear time: possessive where nothing follows that could need less, and
#: begun only where a run of the leading class begins (or the last match ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of words with a digit or an at sign, which may be an identifier.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"

#: What seeds the contexts of secrets: a digest in lower-case hexadecimal, as keys and tokens often are.
SECRET_SEED = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"

#: Production parameters of the bootstrap: different seeds that a pattern needs, share of seeds among what it stands with,
#: and the characters around a candidate that make its context. Confidences are cut to thousandths, so that rounds end.
LEAST_SEEDS = 5
STEPS = 1000
#: Rounds after which scores that still change are an error.
MOST_ROUNDS = 100
#: Matches that are placed in one fold; longer lists are folded in blocks.
BLOCK = 128
LEAST_CONFIDENCE = 0.8
CONTEXT = 60

SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second one from the right is doubled, nine taken off above nine."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _fits(kind: str, value: Column) -> Column:
    """The test that a match must pass."""
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, matches: Column, rank: int) -> Column:
    """The matches with start and end in code points. What `split` leaves between them gives the distances.

    Lists are folded in blocks of BLOCK: one fold over the blocks' lengths places the blocks, one in each its matches. So
    a text of very many matches is not copied once per match.
    """
    between = F.split(text, pattern, -1)
    reach = lambda x: x.gap + F.length(x.m)

    def placed(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("pos"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(
            (a.pos + reach(x)).alias("pos"),
            F.concat(a.out, F.array(F.struct(
                (a.pos + x.gap).alias("start"), F.lit(rank).alias("rank"), (a.pos + reach(x)).alias("end"), x.m.alias("value"),
            ).cast("struct<start:bigint,rank:int,end:bigint,value:string>"))).alias("out"))).out

    def located(pieces: Column) -> Column:
        both = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))
        numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        blocks = F.transform(F.array(both), lambda items: F.transform(numbers, lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))))[0]
        return F.transform(F.array(blocks), in_blocks)[0]

    def in_blocks(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(blocks, zero, lambda a, block: F.struct(
            (a.pos + F.aggregate(block, F.lit(0).cast("bigint"), lambda n, x: n + reach(x))).alias("pos"),
            F.concat(a.out, F.array(a.pos)).alias("out"))).out
        return F.flatten(F.zip_with(blocks, starts, placed))

    return F.when(F.size(matches) > 0, F.transform(F.array(between), located)[0]).otherwise(F.array().cast(SPAN))


def _contexts(text: Column, matches: Column, spans: Column) -> Column:
    """For every candidate: start, end, value, and its patterns: the words around it, in three widths."""
    pieces = F.split(text, CANDIDATE, -1)

    def one(span: Column, i: Column, between: Column) -> Column:
        left = F.lower(F.substring(F.get(between, i), -CONTEXT, CONTEXT))
        right = F.lower(F.substring(F.get(between, i + 1), 1, CONTEXT))
        word = F.regexp_extract(left, r"(\S+)\s*$", 1)
        two = F.regexp_replace(F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1), r"\s+", " ")
        after = F.regexp_extract(right, r"^\s*(\S+)", 1)
        return F.struct(span.start.alias("start"), span.end.alias("end"), span.value.alias("value"), F.filter(F.array(
            F.when(two != "", F.concat(F.lit("2 "), two)), F.when(word != "", F.concat(F.lit("1 "), word)),
            F.when((word != "") & (after != ""), F.concat(F.lit("0 "), word, F.lit(" _ "), after)),
        ), lambda p: p.isNotNull()).alias("patterns"))

    found = F.transform(F.array(pieces), lambda between: F.transform(spans, lambda s, i: one(s, i, between)))[0]
    kind = "array<struct<start:bigint,end:bigint,value:string,patterns:array<string>>>"
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(kind))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, base, candidates) for every row: the valid base spans, and the candidates with their contexts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t"))
    patterns = {**PATTERNS, "candidate": CANDIDATE}
    rows = with_computed(rows, {f"m_{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    rows = with_computed(rows, {
        **{k: _valid(k, _spans(F.col("t"), PATTERNS[k], F.col(f"m_{k}"), rank)) for rank, k in enumerate(BASE)},
        "found": _spans(F.col("t"), CANDIDATE, F.col("m_candidate"), 9),
    })
    return with_computed(rows, {
        "base": F.array_sort(F.concat(*BASE)),
        "candidates": _contexts(F.col("t"), F.col("m_candidate"), F.col("found")),
    }).select("doc_id", "text_hash", "base", "candidates")


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _fits(kind, s.value))


def _seeds(value: Column) -> list[Column]:
    """For each kind, 1.0 where a candidate holds a valid base match of it, or is a digest."""
    out = [F.when(value.rlike(SECRET_SEED), 1.0).otherwise(0.0).alias("secret")]
    for kind in BASE:
        matches = F.regexp_extract_all(value, F.lit(PATTERNS[kind]), F.lit(0))
        out.append(F.when(F.exists(matches, _tester(kind)), 1.0).otherwise(0.0).alias(kind))
    return out


def _tester(kind: str):
    return lambda m: _fits(kind, m)


def _shaped(kind: str, value: Column) -> Column:
    """Whether a candidate could be of the kind at all: the coarse look of one, without the exact form."""
    n = F.length(_digits(value))
    return {
        "email": value.rlike("@"),
        "ip": value.rlike(r"^[0-9]+(?:[.:,][0-9]+){2,}$"),
        "card": value.rlike(r"^[0-9][0-9 .-]*$") & n.between(12, 19),
        "phone": value.rlike(r"^\(?[0-9][0-9 ()./-]*$") & n.between(7, 15),
        "secret": value.rlike(r"^[A-Za-z0-9_+/=.-]{16,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
    }[kind]


def bootstrapped(occurrences: DataFrame, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence): the patterns that discover, after scoring the graph of patterns and values in rounds.

    `occurrences` has (value, patterns). An edge joins a pattern with a value it stands at. Values that hold a base match
    or are a digest are seeds of score 1. A pattern's confidence in a kind is the mean score of its different values, and
    it needs `least_seeds` different seeds; a value that is no seed scores the best confidence of its patterns, if that is
    high enough and its look agrees, so it supports other patterns in the next round. Scores never fall, and rounds go on
    until none changes.
    """
    edges = occurrences.select("value", F.explode("patterns").alias("pattern")).distinct()
    edges = stored(edges.select("value", "pattern", *_seeds(F.col("value"))), "edges")
    scores = [F.greatest(F.col(k), F.coalesce(f"s_{k}", F.lit(0.0))) for k in KINDS]
    values, before = None, None
    for _ in range(MOST_ROUNDS):
        now = edges if values is None else edges.join(values, "value", "left").select(
            "value", "pattern", *(s.alias(k) for k, s in zip(KINDS, scores)), *(F.col(k).alias(f"seed_{k}") for k in KINDS))
        seed = [F.sum(k if values is None else f"seed_{k}").alias(f"seeds_{k}") for k in KINDS]
        # Sums in whole steps, so that they do not depend on the order of the values.
        mean = [F.floor(F.sum((F.col(k) * STEPS).cast("long")) / F.count("*")) / STEPS for k in KINDS]
        patterns = now.groupBy("pattern").agg(*(m.alias(k) for k, m in zip(KINDS, mean)), *seed)
        good = F.array(*(F.when((F.col(k) >= least_confidence) & (F.col(f"seeds_{k}") >= least_seeds), F.struct(
            F.lit(k).alias("kind"), F.col(k).alias("confidence"))) for k in KINDS))
        patterns = stored(patterns.select("pattern", F.explode(F.filter(good, lambda g: g.isNotNull())).alias("g")).select(
            "pattern", "g.kind", "g.confidence"), "patterns")
        state = patterns.agg(F.count("*"), F.sum((F.col("confidence") * STEPS).cast("long"))).first()
        if state == before:
            return patterns
        before = state
        looks = [F.when((F.col("kind") == k) & _shaped(k, F.col("value")), F.col("confidence")) for k in KINDS]
        values = stored(edges.where(" + ".join(KINDS) + " = 0").select("value", "pattern").join(patterns, "pattern").groupBy("value").agg(
            *(F.max(x).alias(f"s_{k}") for k, x in zip(KINDS, looks))), "values")
    raise RuntimeError("the scores of patterns did not settle")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = LEAST_SEEDS,
    least_confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """(doc_id, base, added) for every row: spans as (start, rank of kind, end, value), in code points, end exclusive.

    `base` holds the leftmost non-overlapping matches of the fixed patterns that pass their tests, per kind, by start
    then kind. `added` holds what the bootstrapped patterns discover: candidates that touch no base span, look like the
    kind, and stand in a context of high confidence. A null text is empty. Rows that agree in id and text get equal
    results. An empty table gives an empty one. One pass reads the texts; what is joined afterwards are spans.
    """
    rows = stored(scanned(docs, id_col, text_col), "scanned")
    found = rows.select("doc_id", "text_hash", "base", F.explode("candidates").alias("c")).select(
        "doc_id", "text_hash", "base", "c.start", "c.end", "c.value", "c.patterns")
    front = F.regexp_extract("value", r"^[^A-Za-z0-9+(@]*", 0)
    core = F.regexp_replace("value", r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$", "")
    found = found.withColumn("start", F.col("start") + F.length(front)).withColumn("value", core).withColumn(
        "end", F.col("start") + F.length("value"))
    patterns = bootstrapped(found.select("value", "patterns"), least_seeds, least_confidence)
    free = ~F.exists("base", lambda s: (s.start < F.col("end")) & (s.end > F.col("start")))
    open_ = found.where(free).select("doc_id", "text_hash", "start", "end", "value", F.explode("patterns").alias("pattern"))
    hits = open_.join(patterns, "pattern")
    rank = F.coalesce(*(F.when((F.col("kind") == k) & _shaped(k, F.col("value")), n) for n, k in enumerate(KINDS)))
    added = hits.select("doc_id", "text_hash", F.struct("start", rank.alias("rank"), "end", "value").alias("s")).where(
        "s.rank is not null").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "added")
    return rows.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s.start.cast("string"), s.end.cast("string"))), ",")


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and hash of the base spans, all spans
    listed, and how many of them the bootstrap added."""
    found = find_personal_data(docs, id_col, text_col, **how)
    counts = [F.size(F.filter("base", _of_rank(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank
