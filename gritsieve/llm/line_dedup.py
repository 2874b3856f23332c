"""Removal of repeated runs of lines by winnowing over line hashes, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritsieve.llm.shared import SPACES, WORD, free_name, stored, with_computed
from gritsieve.operators.ranks import lookup

#: Production parameters, in words: the shortest run that is evidence at all, and the length from which a repeated run of
#: whole lines is sure to be found.
GRAM_WORDS = 20
GUARANTEE_WORDS = 50

_DOC = ["_null", "_doc", "_text_hash"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with words: the document, the line's position, hash, words, and the words before it.

    Spaces at a line's ends do not count. Rows that agree in id and text are one document here.
    """
    line = F.regexp_replace("line", f"^{SPACES}|{SPACES}$", "")
    rows = (
        docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
        .select(F.col("_doc").isNull().alias("_null"), "_doc", F.xxhash64("_text").alias("_text_hash"),
                F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(WORD))
        .select(*_DOC, "pos", F.xxhash64(line).alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n"))
    )
    # One shuffle by document serves the grouping and all windows below.
    rows = rows.repartition(*_DOC).groupBy(*_DOC, "pos").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    order = W.partitionBy(*_DOC).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("ends", F.sum("n").over(order)).withColumn("starts", F.col("ends") - F.col("n"))


def _fingerprints(lines: DataFrame, gram_words: int, guarantee_words: int) -> DataFrame:
    """The chosen fingerprints: gram hash, document, position, and the lines around it as (hash, position).

    A gram is the shortest run of lines from a given line on that has `gram_words` words; its fingerprint is the hash
    of its lines. A window is the shortest run that has `guarantee_words`; of the grams inside it, the one with the
    smallest hash is chosen, the last of equals. As lines have a word each, every frame below has bounded length.
    """
    order = W.partitionBy(*_DOC).orderBy("starts")
    ahead = lambda n: order.rangeBetween(W.currentRow, n - 1)
    until = W.partitionBy(*_DOC).orderBy("ends").rangeBetween(W.currentRow, guarantee_words)
    gram_end = F.max("ends").over(ahead(gram_words))
    grams = lines.withColumn("after", F.collect_list(F.struct("h", "pos")).over(until)).withColumns({
        "gram_end": F.when(gram_end - F.col("starts") >= gram_words, gram_end),
        "gram": F.xxhash64(F.collect_list("h").over(ahead(gram_words))),
        "before": F.collect_list(F.struct("h", "pos")).over(order.rangeBetween(-guarantee_words, -1)),
        "window_end": F.max("ends").over(ahead(guarantee_words)),
    })
    gram = F.when(F.col("gram_end").isNotNull(), F.struct("gram", (-F.col("pos")).alias("minus"), "gram_end"))
    chosen = F.array_min(F.filter("inside", lambda g: g.gram_end <= F.col("window_end")))
    choosing = F.collect_list("choice").over(order.rangeBetween(1 - guarantee_words, W.currentRow))
    return (
        grams.withColumn("inside", F.collect_list(gram).over(ahead(guarantee_words)))
        .withColumn("choice", F.when(F.col("window_end") - F.col("starts") >= guarantee_words, -chosen.minus))
        .withColumn("chosen", F.array_contains(choosing, F.col("pos")))
        .where("chosen").select(*_DOC, "pos", "gram", "before", "after")
    )


def _extensions(side: str, around: Column) -> Column:
    """For each line of an array of (h, pos): the hash of gram, side and all lines up to this one, and its position."""
    return F.transform(around, lambda x, i: F.struct(
        F.xxhash64("gram", F.lit(side), F.transform(F.slice(around, F.lit(1), i + 1), lambda y: y.h)).alias("reach"),
        x.pos.alias("line")))


def repeated_lines(
    docs: DataFrame, id_col: str, text_col: str, gram_words: int = GRAM_WORDS, guarantee_words: int = GUARANTEE_WORDS
) -> DataFrame:
    """(_null, _doc, _text_hash, cut): the positions of the lines to delete, for each document that has any."""
    chosen = stored(_fingerprints(_lines(docs, id_col, text_col), gram_words, guarantee_words), "fingerprints")
    again = chosen.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("_gram"))
    both = F.concat(_extensions("after", F.col("after")), _extensions("before", F.reverse("before")))
    # One row per line around a fingerprint. Places that agree in gram and in all lines up to this one share its hash, so
    # its first place is the first of all places, whatever else surrounds them, and no two places are compared.
    reached = stored(
        chosen.join(again, F.col("gram") == F.col("_gram"), "left_semi")
        .select(F.struct(*_DOC, "pos").alias("place"), F.inline(both)), "reached"
    )
    first = reached.groupBy("reach").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    # A passage that very many documents share is a hot key; its first place comes to its rows by broadcast.
    runs = lookup(reached, stored(first, "first-places"), ["reach"], "inner", times="times")
    return runs.where("place != first").select("place.*", "line").groupBy(*_DOC).agg(F.collect_set("line").alias("cut"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram_words: int = GRAM_WORDS,
    guarantee_words: int = GUARANTEE_WORDS,
) -> DataFrame:
    """Every row of `docs`, its text without the runs of lines that an earlier place has too; n_lines and n_cut added.

    Earlier means a smaller (id, hash of text, position); null ids come last. Every run of whole lines with at least
    `guarantee_words` words that stood at an earlier place is found; a run with fewer than `gram_words` words is never
    deleted, and one between the two may be. A fingerprint is extended both ways, `guarantee_words` words at most, line by
    line, as far as any earlier place goes along; since windows overlap, that covers the whole run, from wherever its parts
    came. The first place of a line keeps it. Blank lines stay.
    A null text stays null and has no lines. Rows that agree in id and text are one document, and get equal results.
    An empty table gives an empty one. If `docs` has columns n_lines or n_cut, the added ones get an underscore.
    """
    n_lines, n_cut, key, cut, shorter = (
        free_name(docs, n) for n in ("n_lines", "n_cut", "_d_hash", "_d_cut", "_d_text")
    )
    found = repeated_lines(docs, id_col, text_col, gram_words, guarantee_words)
    found = found.select(
        F.col("_doc").alias("_f_doc"), F.col("_text_hash").alias("_f_hash"), F.col("cut").alias(cut)
    )
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    out = docs.withColumn(key, F.xxhash64(text))
    out = out.join(found, own.eqNullSafe(F.col("_f_doc")) & (F.col(key) == F.col("_f_hash")), "left").drop(
        "_f_doc", "_f_hash", key
    )
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = with_computed(out, {
        shorter: F.when(F.col(cut).isNull(), text).otherwise(rest),
        n_lines: F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        n_cut: F.coalesce(F.size(cut), F.lit(0)).cast("long"),
    })
    columns = [F.col(shorter).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, n_lines, n_cut)
