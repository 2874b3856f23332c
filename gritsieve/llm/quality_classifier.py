"""Quality classifier: evidence of a document, combined with posteriors of its host and path by empirical Bayes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.shared import stored, text_parts

#: Production parameters: labelled documents used to fit, at most (the first by hash of the id); buckets of word hashes;
#: documents that a bucket's shares are shrunk by, and its weight; the two heads, as SQL over the labels; and the verdict's thresholds.
LABELLED = 40_000
BUCKETS = 1 << 16
SHRINK = 5.0
SUPPORT = 20.0
HEADS = {"good": "quality = 1", "toxic": "toxic = 1"}
THRESHOLD = 0.5
TOXIC_THRESHOLD = 0.75

#: Punctuation that separates words here, besides ASCII spaces.
_APART = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_SYMBOLS = b"#*$%&|<>"
#: Numbers about a text's style, besides one score per head from its words.
STYLE = 8


def style_and_words(data: bytes) -> tuple[list[float], np.ndarray]:
    """The style numbers, and the buckets of the different words."""
    chars = upper = symbols = shouts = digits = total = 0
    counts: Counter[bytes] = Counter()
    for part in text_parts(data):
        raw = part.split()
        total += len(raw)
        chars += sum(map(len, raw))
        symbols += len(part) - len(part.translate(None, _SYMBOLS))
        shouts += part.count(b"!")
        upper += len(part) - len(part.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits += len(part) - len(part.translate(None, b"0123456789"))
        counts.update(part.lower().translate(_APART).split())
    n, c = max(total, 1), max(chars, 1)
    repeated = max(counts.values(), default=0) / max(sum(counts.values()), 1)
    distinct = len(counts) / max(sum(counts.values()), 1)
    style = [np.log1p(total), c / n / 10, min(symbols / n, 3), min(shouts / n, 3), upper / c, digits / c, repeated, distinct]
    return [float(x) for x in style], np.fromiter((crc32(w) % BUCKETS for w in counts), dtype=np.int64, count=len(counts))


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, half, good, toxic): at most `bound` labelled ids; contradicting labels of one id are averaged."""
    heads = [F.avg(F.expr(f"CASE WHEN {rule} THEN 1.0D WHEN {rule} IS NOT NULL THEN 0.0D END")).alias(h) for h, rule in HEADS.items()]
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(*heads).dropna(subset=list(HEADS))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return ids.withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)))


def word_weights(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """For each head and bucket, the log of how much likelier a document with the label has a word of it; shrunk to 0.

    Counted over one half of the labelled documents, in Spark; the result has a fixed size.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(HEADS), 2, BUCKETS + 1))
        for batch in batches:
            for i, data in enumerate(batch["t"]):
                _, buckets = style_and_words(data or b"")
                seen = np.append(np.unique(buckets), BUCKETS)  # the last counts documents
                for k, head in enumerate(HEADS):
                    share = batch[head].iloc[i]
                    total[k, 1, seen] += share
                    total[k, 0, seen] += 1 - share
        head, label, bucket = np.nonzero(total)
        yield pd.DataFrame({"head": head, "label": label, "bucket": bucket, "n": total[head, label, bucket]})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    rows = rows.join(F.broadcast(known.where("half = 0")), "doc_id")
    sums = rows.select("t", *HEADS).mapInPandas(counted, "head int, label int, bucket int, n double")
    found = sums.groupBy("head", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(HEADS), 2, BUCKETS + 1))
    total[found["head"], found["label"], found["bucket"]] = found["n"]
    docs_of = total[:, :, BUCKETS, None]
    every = total[:, :, :BUCKETS].sum(1, keepdims=True) / np.maximum(docs_of.sum(1, keepdims=True), 1)
    share = (total[:, :, :BUCKETS] + SHRINK * every) / (docs_of + SHRINK)
    ratio = np.log(np.maximum(share[:, 1], 1e-9)) - np.log(np.maximum(share[:, 0], 1e-9))
    support = total[:, :, :BUCKETS].sum(1)
    return np.where(support > 0, ratio * support / (support + SUPPORT), 0.0)


def evidence(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, site_cols: list[str]) -> DataFrame:
    """(doc_id, site columns, x): the numbers of every document that the classifiers look at."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch.pop("t"):
                style, buckets = style_and_words(data or b"")
                scores = weights[:, buckets]
                # The mean tells of a whole text's style, the largest three of single words.
                padded = np.hstack([scores, np.zeros((len(HEADS), 3))])
                top = np.partition(padded, -3, axis=1)[:, -3:]
                top.sort(axis=1)
                mean = scores.sum(1) / max(len(buckets), 1)
                out.append([*style, *mean.tolist(), *top.ravel().tolist()])
            batch["x"] = out
            yield batch

    kinds = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *(F.col(f"`{c}`").cast("string").alias(f"site_{i}") for i, c in enumerate(site_cols)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       *(F.col(f"`{c}`").cast("string").alias(f"site_{i}") for i, c in enumerate(site_cols)),
                       F.col(f"`{text_col}`").cast("binary").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema)
    return rows.mapInPandas(measured, f"{schema}, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by Newton steps; weights for the raw numbers, and the intercept."""
    if len(x) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / scale
    return weights, float(beta[-1] - weights @ mean)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Prior observations a group's mean is shrunk by: from how much group means differ beyond what chance explains.

    `groups` has n, s (sum of probabilities) and the mean they are shrunk towards; the moment estimate of a
    beta-binomial, from 1 to a million.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))
    chance = mean * (1 - mean)
    noise = F.sum(chance)
    room = F.sum(F.col("n") * chance) - noise
    ratio = F.when(room > 0, F.greatest(F.lit(1e-6), (spread - noise) / room)).otherwise(1e-6)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), (1 - ratio) / ratio))


def site_posteriors(rows: DataFrame, p: str, site_cols: list[str]) -> DataFrame:
    """`rows` with `prior`: the posterior mean of the document's site without the document itself, level by level.

    Each level's mean is shrunk towards the level above, the first towards the corpus: (sum - own + k * above) / (n - 1 +
    k). Sums are grouped aggregates; a hot site is combined map-side, and joined back as a skewed side.
    """
    total = rows.agg(F.avg(p).alias("m")).first()["m"]
    total = min(max(total if total is not None else 0.5, 1e-4), 1 - 1e-4)
    sites, above = None, F.lit(total)
    for level in range(len(site_cols)):
        keys = site_cols[: level + 1]
        groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(p).alias("s"))
        if sites is None:
            groups = groups.withColumn("above", above)
        else:
            upper = sites.select(*(F.col(c).alias(f"_{c}") for c in keys[:-1]), F.col(f"mean_{level - 1}").alias("above"))
            same = [groups[c].eqNullSafe(upper[f"_{c}"]) for c in keys[:-1]]
            groups = groups.join(upper, same).drop(*(f"_{c}" for c in keys[:-1]))
        groups = stored(groups, "sites")
        k = groups.agg(_strength(groups, F.col("above")).alias("k")).first()["k"] or 1.0
        sites = groups.withColumn(f"mean_{level}", (F.col("s") + k * F.col("above")) / (F.col("n") + k)).withColumn("k", F.lit(float(k)))
    own = sites.select(*(F.col(c).alias(f"_{c}") for c in site_cols), "n", "s", "above", "k")
    joined = rows.join(own, [rows[c].eqNullSafe(own[f"_{c}"]) for c in site_cols], "left")
    prior = (F.col("s") - F.col(p) + F.col("k") * F.col("above")) / (F.col("n") - 1 + F.col("k"))
    return joined.withColumn("prior", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), prior))).drop(
        "n", "s", "above", "k", *(f"_{c}" for c in site_cols)).withColumn("everywhere", F.lit(total))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    site_cols: tuple[str, ...] = ("source", "lang"), bound: int = LABELLED, threshold: float = THRESHOLD,
    toxic_threshold: float = TOXIC_THRESHOLD,
) -> DataFrame:
    """(doc_id, evidence, site, quality, toxic, kept) for every row of `docs`.

    evidence: the probability of the good label by the document alone. site: the posterior of its host and path
    (`site_cols`, from wide to narrow), from all documents there but itself. quality: both combined, as odds. toxic: the
    probability of the toxic label by the document alone. kept: quality >= `threshold` and toxic < `toxic_threshold`.

    Word weights are counted on one half of at most `bound` labelled documents, the regression is fitted on the other;
    every document is scored. Without labels all probabilities are 0.5 and all is kept. A null text is empty, null
    sites are one site. Repeated rows stay, and count as often as they stand. An empty table gives an empty one.
    """
    sites = [f"site_{i}" for i in range(len(site_cols))]
    known = stored(labelled(labels, bound), "labelled")
    weights = word_weights(docs, known, id_col, text_col)
    rows = stored(evidence(docs, weights, id_col, text_col, list(site_cols)), "evidence")
    sample = rows.join(F.broadcast(known.where("half = 1")), "doc_id").groupBy("doc_id").agg(
        *(F.first(c).alias(c) for c in ("x", *HEADS))).toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(len(sample), STYLE + 4 * len(HEADS))
    for head in HEADS:
        beta, intercept = fit(x, (sample[head].to_numpy(dtype=np.float64) >= 0.5).astype(float))
        linear = F.lit(intercept)
        for i, b in enumerate(beta):
            linear = linear + F.get("x", F.lit(i)) * float(b)
        rows = rows.withColumn(head, F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), _sigmoid(linear))))
    rows = stored(rows.drop("x"), "scored")
    out = site_posteriors(rows, "good", sites)
    quality = _sigmoid(_logit(F.col("good")) + _logit(F.col("prior")) - _logit(F.col("everywhere")))
    return out.select(
        "doc_id", F.col("good").alias("evidence"), F.col("prior").alias("site"), quality.alias("quality"), "toxic"
    ).withColumn("kept", (F.col("quality") >= threshold) & (F.col("toxic") < toxic_threshold))
