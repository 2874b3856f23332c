"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.shared import WORD, free_name, stored, with_computed, words

#: Production parameters.
BUCKETS = 10_000
#: Words per bucket, shared out as in the raw corpus, that the trusted counts start from: little evidence weighs little.
PRIOR = 10
#: Documents are dealt to folds by the hash of their ids; one is judged by the trusted documents of the other folds.
FOLDS = 5
#: The cut: so many standard deviations below the lowest held-out score of a trusted document, but at most so many below
#: where the lowest of as many normal scores would lie. The deviation starts from SPREAD as if SPREAD_DOCS documents had it.
BELOW_LOWEST = 1.0
BELOW_NORMAL = 1.5
SPREAD = 0.02
SPREAD_DOCS = 30
#: Held-out scores are summed in units of 1 / SCALE, as whole numbers, so that the cut does not depend on their order.
SCALE = 1 << 30
#: Bits of the filter that picks documents with trusted ids.
FILTER_BITS = 1 << 23
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50


def _buckets(ws: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words of one text."""
    number = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets)).cast("int")
    firsts, seconds = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.size(ws))
    return F.concat(F.transform(ws, lambda w: number(w)), F.zip_with(firsts, seconds, lambda a, b: number(a, b)))


def _fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_trusted): the ids labelled quality 1 and toxic 0, each once."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()


def _place(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS)) + 1


def id_filter(trusted: DataFrame) -> DataFrame:
    """(_bucket, _bits): the hashes of all trusted ids as bitmaps, FILTER_BITS bits in all, whatever the number of ids."""
    place = _place(F.col("_trusted"))
    return trusted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def _perhaps(id_col: Column) -> Column:
    """Whether the bit of an id is set in its bitmap `_bits`: never false for a trusted one."""
    at = F.bitmap_bit_position(_place(id_col)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(1) == 1, F.lit(False))


def _flagged(docs: DataFrame, ids: DataFrame, id_col: Column, name: str) -> DataFrame:
    """`docs` with whether the filter over `ids` picks their id; the filter is FILTER_BITS / 32768 rows of 4 KB at most."""
    picked = docs.join(F.broadcast(id_filter(ids)), F.bitmap_bucket_number(_place(id_col)) == F.col("_bucket"), "left")
    return picked.select(*(F.col(f"`{c}`") for c in docs.columns), _perhaps(id_col).alias(name))


def _of_trusted(picked: DataFrame, trusted: DataFrame) -> DataFrame:
    """Of documents (_id, fold, n, grams) that the filter picked, those with a trusted id.

    The ids it picked wrongly, found by ids alone, make a second filter: what that does not pick is trusted for sure, and
    only the few others take their n-grams to a join with the ids.
    """
    wrong = stored(picked.select(F.col("_id").alias("_trusted")).distinct().join(trusted, "_trusted", "left_anti"), "wrong")
    flagged = _flagged(picked, wrong, F.col("_id"), "_doubt")
    others = flagged.where("_doubt").join(trusted, F.col("_id") == F.col("_trusted"), "left_semi")
    return flagged.where("not _doubt").unionByName(others).select("fold", "n", "grams")


def ngram_weights(grams: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, held): for each fold, log of the trusted share of a bucket, counted in the other folds, over its raw share.

    `grams` has the n-grams of every document, `good` those of every trusted one with its fold. One is added to every raw
    count; the trusted counts start from PRIOR * `buckets` n-grams in the raw shares.
    """
    raw = grams.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"))
    own = good.select("fold", F.explode("grams").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("trusted"), *(F.count_if(F.col("fold") == k).alias(f"own_{k}") for k in range(FOLDS)))
    counts = raw.join(own, "bucket", "left")
    every = grams.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    totals = stored(every.join(counts, "bucket", "left").fillna(0), "ngrams")
    everything = W.partitionBy()  # one task, of exactly `buckets` rows
    raw = (F.col("raw") + 1) / (F.sum("raw").over(everything) + buckets)
    prior = PRIOR * buckets

    def weight(n: Column) -> Column:
        return F.log((n + prior * raw) / (F.sum(n).over(everything) + prior)) - F.log(raw)

    held = F.array(*(weight(F.col("trusted") - F.col(f"own_{k}")) for k in range(FOLDS)))
    return totals.select("bucket", held.alias("held"))


def _vector(weights: DataFrame) -> Column:
    """The weights of all folds and buckets as one value, FOLDS * buckets numbers: that of bucket b in fold k is number
    k * buckets + b. A subquery reads it, so that plans, whose texts the driver keeps, name it and do not spell it out."""
    rows = F.sort_array(F.collect_list(F.struct("bucket", "held")))  # one for each bucket
    folds = F.array(*(F.lit(k) for k in range(FOLDS)))
    vector = F.flatten(F.transform(folds, lambda k: F.transform(F.col("rows"), lambda r: F.get(r.held, k))))
    return stored(weights.agg(rows.alias("rows")).select(vector.alias("vector")), "vector").scalar()


def _with_mean(df: DataFrame, name: str, grams: Column, fold: Column, vector: Column, buckets: int) -> DataFrame:
    """`df` with the mean weight of each row's n-grams. No lambda function may hold a subquery, so it is a column first; as
    that is used once, the optimizer puts the subquery in its place, and no row carries the weights."""
    numbers = free_name(df, "_q_vector")
    start = fold * buckets
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(F.col(numbers), start + g))
    mean = F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*own, vector.alias(numbers)).select(*own, mean.alias(name))


def cut_of(good: DataFrame, vector: Column, buckets: int = BUCKETS) -> DataFrame:
    """(cut): the least held-out score that is kept, from those of all trusted documents with MIN_WORDS words or more.

    Null without any: then there is nothing to compare with, and none is too low.
    """
    rows = _with_mean(good.where(F.col("n") >= MIN_WORDS), "mean", F.col("grams"), F.col("fold"), vector, buckets)
    sums = rows.select(F.round(F.col("mean") * SCALE).cast("decimal(18,0)").alias("x")).agg(
        F.count("x").alias("n"), F.min("x").cast("double").alias("low"), F.sum("x").cast("double").alias("s"),
        F.sum(F.col("x") * F.col("x")).cast("double").alias("ss"),
    )
    n, mean = F.col("n"), F.col("s") / F.col("n")
    around = F.greatest(F.col("ss") - n * mean * mean, F.lit(0.0)) + SPREAD_DOCS * (SPREAD * SCALE) ** 2
    sd = F.sqrt(around / (n + SPREAD_DOCS))
    cut = F.greatest(F.col("low") - BELOW_LOWEST * sd, mean - (F.sqrt(2 * F.log(n)) + BELOW_NORMAL) * sd) / SCALE
    return sums.select(F.when(n > 0, cut).alias("cut"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float | None = None,
    buckets: int = BUCKETS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of `docs` with its counts, its score and the verdict `kept`, under the names below.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept. If a column of `docs`
    bears such a name, the added one gets an underscore; `keep` names the columns of `docs` to return, all by default. A null
    text has no words. `score` is the mean weight of a text's n-grams (0 without any), with weights from the trusted
    documents of the other folds, so that no document is judged by its own counts. A text fails the base rules with under
    50 words, or when over half its words stand in three-word windows found twice or more. Kept is what passes them with
    a score of at least `threshold`; without one the cut follows from the scores of the trusted documents (`cut_of`).
    Repeated rows get equal verdicts; an empty table gives an empty one.
    Windows are compared by 64-bit hash. Texts are read once: their counts and n-grams are written, and one fold over the
    n-grams with all weights as one value gives the scores. Texts are not shuffled, and n-grams hardly: filters of fixed size
    over ids tell trusted documents (`_of_trusted`).
    """
    keep = docs.columns if keep is None else keep
    trusted = stored(trusted_ids(labels), "trusted")
    name = {n: free_name(docs, n) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept",
    )}
    ws, lines, seen, grams, own, perhaps, mean = (
        free_name(docs, n) for n in ("_q_words", "_q_lines", "_q_seen", "_q_grams", "_q_id", "_q_perhaps", "_q_mean")
    )
    col = lambda n: F.col(f"`{n}`")

    out = _flagged(docs, trusted, col(id_col), perhaps)
    out = with_computed(out, {ws: words(col(text_col))})
    out = with_computed(out, {
        lines: F.filter(F.split(F.coalesce(col(text_col), F.lit("")), "\n"), lambda x: x.rlike(WORD)),
        seen: _window_hashes(col(ws)),
    })
    n, repeated = col(name["n_words"]), col(name["n_repeat_words"])
    measured = stored(out.select(*(col(c) for c in keep), *(c.alias(a) for a, c in {
        name["n_words"]: F.size(ws).cast("long"),
        name["word_chars"]: F.length(F.array_join(ws, "")).cast("long"),
        name["n_symbols"]: F.length(F.regexp_replace(F.coalesce(col(text_col), F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"),
        name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        name["n_repeat_words"]: F.when(
            F.size(F.array_distinct(seen)) < F.size(seen), _repeated_words(col(seen))
        ).otherwise(0).cast("long"),
        grams: _buckets(col(ws), buckets),
        own: col(id_col),
        perhaps: col(perhaps),
    }.items())), "measured")
    good = _of_trusted(measured.where(col(perhaps)).select(
        col(own).alias("_id"), _fold(col(own)).alias("fold"), n.alias("n"), col(grams).alias("grams")), trusted)
    vector = _vector(stored(ngram_weights(measured.select(col(grams).alias("grams")), good, buckets), "weights"))
    cut = F.lit(threshold)
    if threshold is None:
        cut = stored(cut_of(good, vector, buckets), "cut").agg(F.first("cut")).scalar()
    out = _with_mean(measured, mean, col(grams), _fold(col(own)), vector, buckets)
    out = with_computed(out, {name["score"]: col(mean)})
    out = out.withColumn(
        name["base_failed"], (n < MIN_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
    )
    out = out.withColumn(name["kept"], ~col(name["base_failed"]) & (cut.isNull() | (col(name["score"]) >= cut)))
    return out.select(*(col(c) for c in keep), *(col(a) for a in name.values()))


def _window_hashes(ws: Column) -> Column:
    """A 64-bit hash for each three-word window, in order."""
    return F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    )


def _repeated_words(hashes: Column) -> Column:
    """How many words stand in a window whose hash occurs twice or more: neighbours in sorted order, then positions."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda x, j: (x.h == F.get(sorted_, j - 1).h) | (x.h == F.get(sorted_, j + 1).h))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    # A one-element array binds the sorted windows to a name, so that they are sorted once.
    return F.transform(F.array(ordered), again)[0]
