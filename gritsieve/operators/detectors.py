"""Quality detectors. Each reads `Evidence` and yields rows of the findings relation."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window as W, functions as F

from gritsieve import constants as K
from gritsieve.functions.cells import ROW_ID, name_tokens, named, number
from gritsieve.operators.evidence import Evidence, first_row, plausible_range, with_evidence, words_of
from gritsieve.relations import FINDINGS, data_columns, is_text, local_relation

TABLE = "<table>"


def _finding(kind, subject, confidence, n_affected, detail, op=None, **params) -> dict:
    return {
        "kind": kind, "column": subject, "confidence": float(confidence), "n_affected": int(n_affected),
        "detail": detail, "op": op, "params": json.dumps(params, ensure_ascii=False) if op else None,
    }


def _relation(ev: Evidence, found: list[dict]) -> DataFrame:
    return local_relation(ev.df.sparkSession, found, FINDINGS)


def _known(ev: Evidence, *kinds: str) -> DataFrame:
    """Counted values of the columns of these kinds, with the table's row count."""
    stats = F.broadcast(ev.stats.filter(F.col("kind").isin(*kinds)).select("column", "kind", "n_rows"))
    return ev.counts.join(stats, "column")


def _whole(ev: Evidence, *kinds: str) -> DataFrame:
    """As `_known`, without columns of which only the missing-data codes were counted."""
    return _known(ev, *kinds).filter(F.col("column").isin(ev.counted_columns()))


def _answers(ev: Evidence, least: int, most: int) -> DataFrame:
    """(column, norm, n, d): normalised answers of the text columns that have from `least` to `most` of them."""
    found = {c: forms for c, (_, forms) in ev.sizes().items() if least <= forms <= most and ev.kinds[c] == "text"}
    sized = local_relation(ev.df.sparkSession, [{"column": c, "d": d} for c, d in found.items()], "column string, d bigint")
    counted = ev.counts.filter(F.col("column").isin(sorted(found))).groupBy("column", "norm").agg(F.sum("n").alias("n"))
    return counted.join(F.broadcast(sized), "column")


# Detectors over value counts


def sentinel_missing(ev: Evidence, threshold: float = K.CODE_THRESHOLD) -> DataFrame:
    """One finding per column and confidence, so that a sure code never takes a doubtful one along."""
    spark = ev.df.sparkSession
    words = local_relation(
        spark,
        [{"norm": code, "word_conf": conf} for code, conf in K.TEXT_CODES.items()],
        "norm string, word_conf double",
    )
    digits = local_relation(
        spark,
        [{"code": float(code), "digit_conf": conf} for code, conf in K.NUMERIC_CODES.items()],
        "code double, digit_conf double",
    )
    raw = F.coalesce(F.when(F.col("kind") == "text", F.col("word_conf")), F.col("digit_conf"))
    confidence = F.when(F.col("n") / F.col("n_rows") > K.MAJORITY_SHARE, raw * K.MAJORITY_DISCOUNT).otherwise(raw)
    hits = (
        _known(ev, "text", "number")
        .join(F.broadcast(words), "norm", "left")
        .join(F.broadcast(digits), number(F.col("norm")) == F.col("code"), "left")
        .withColumn("conf", confidence)
        .filter(F.col("conf") >= threshold)
    )
    return hits.groupBy("column", F.col("conf").alias("confidence")).agg(
        F.sum("n").alias("n_affected"),
        F.max("n_rows").alias("n_rows"),
        F.sort_array(F.collect_list("value")).alias("values"),
    ).select(
        F.lit("sentinel_missing").alias("kind"), "column", "confidence", "n_affected",
        F.format_string(
            "%d values (%.1f%%) look like missing-data codes: %s", "n_affected",
            100 * F.col("n_affected") / F.col("n_rows"), F.concat_ws(", ", "values"),
        ).alias("detail"),
        F.lit("recode_sentinel_missing").alias("op"),
        F.to_json(F.struct("column", "values")).alias("params"),
    )


def likert_scale(ev: Evidence) -> DataFrame:
    levels = local_relation(
        ev.df.sparkSession,
        [
            {"scale_no": s, "scale": name, "place": p, "norm": level}
            for s, (name, scale) in enumerate(K.SCALES.items())
            for p, level in enumerate(scale)
        ],
        "scale_no int, scale string, place int, norm string",
    )
    best = W.partitionBy("column").orderBy(F.desc("overlap"), "scale_no")
    matched = (
        _answers(ev, 2, 8).join(F.broadcast(levels), "norm")
        .groupBy("column", "scale_no", "scale", "d")
        .agg(
            F.count(F.lit(1)).alias("hits"), F.sum("n").alias("n_affected"),
            F.array_sort(F.collect_list(F.struct("place", "norm"))).alias("found"),
        )
        .withColumn("overlap", F.col("hits") / F.col("d"))
        .withColumn("place", F.row_number().over(best))
        .filter((F.col("place") == 1) & (F.col("overlap") >= 0.75))
        .withColumn("order", F.transform("found", lambda f: f["norm"]))
    )
    return matched.select(
        F.lit("likert_scale").alias("kind"), "column",
        F.bround(F.least("overlap", F.lit(0.95)), 2).alias("confidence"), "n_affected",
        F.format_string("Answers follow the %s scale but are stored without its order", "scale").alias("detail"),
        F.lit("order_likert").alias("op"), F.to_json(F.struct("column", "order")).alias("params"),
    )


def value_synonyms(ev: Evidence) -> DataFrame:
    aliases = local_relation(
        ev.df.sparkSession,
        [
            {"vocab_no": v, "vocab": name, "hint": vocab["hint"], "answer": answer, "norm": alias}
            for v, (name, vocab) in enumerate(K.VOCABULARIES.items())
            for answer, spellings in vocab["answers"].items()
            for alias in spellings
        ],
        "vocab_no int, vocab string, hint string, answer string, norm string",
    )
    per_vocab = W.partitionBy("column", "vocab_no")
    best = W.partitionBy("column").orderBy(F.desc("score"), "vocab_no")
    hinted = F.rlike(name_tokens(F.col("column")), F.col("hint"))
    # At most fourteen rows a column; the spellings join them afterwards.
    chosen = (
        _answers(ev, 3, 14).join(F.broadcast(aliases), "norm")
        .withColumn("known", F.size(F.collect_set("norm").over(per_vocab)))
        .withColumn("answers", F.size(F.collect_set("answer").over(per_vocab)))
        .filter((F.col("known") / F.col("d") >= 0.6) & (F.col("answers") == 2))
        .withColumn("score", F.col("known") / F.col("d") + F.when(hinted, 0.3).otherwise(0.0))
        .withColumn("chosen", F.first("vocab_no").over(best))
        .filter("vocab_no = chosen")
        .select("column", "norm", "vocab", "answer", "d", "known")
    )
    covered = _whole(ev, "text").join(F.broadcast(chosen), ["column", "norm"])
    return (
        covered.filter(F.col("value") != F.col("answer"))
        .groupBy("column", "vocab", "d", "known")
        .agg(
            F.sum("n").alias("n_affected"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "answer")))).alias("mapping"),
        )
        .select(
            F.lit("value_synonyms").alias("kind"), "column",
            F.when(F.col("d") - F.col("known") <= 2, F.lit(0.93)).otherwise(F.lit(0.85)).alias("confidence"),
            "n_affected",
            F.format_string(
                "%d spellings of a two-answer %s variable; %d value(s) not recognised and left alone",
                "d", "vocab", F.col("d") - F.col("known"),
            ).alias("detail"),
            F.lit("map_categories").alias("op"), F.to_json(F.struct("column", "mapping")).alias("params"),
        )
    )


def case_variants(ev: Evidence) -> DataFrame:
    bucket = W.partitionBy("column", "norm").orderBy(F.desc("n"), F.col("first_row").asc_nulls_last(), "value")
    few = [c for c, d in ev.distinct_at_most(60).items() if d >= 2]
    # At most sixty rows a column.
    spelled = (
        _whole(ev, "text").filter(F.col("column").isin(few))
        .withColumn("d", F.count(F.lit(1)).over(W.partitionBy("column")))
        .withColumn("place", F.row_number().over(bucket))
        .withColumn("main", F.first("value").over(bucket))
        .filter("place > 1")
    )
    return (
        spelled.groupBy("column", "d")
        .agg(
            F.sum("n").alias("n_affected"), F.count(F.lit(1)).alias("folded"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "main")))).alias("mapping"),
        )
        .select(
            F.lit("case_variants").alias("kind"), "column", F.lit(0.92).alias("confidence"), "n_affected",
            F.format_string(
                "%d categories become %d once case and outer blanks are ignored", "d", F.col("d") - F.col("folded")
            ).alias("detail"),
            F.lit("map_categories").alias("op"), F.to_json(F.struct("column", "mapping")).alias("params"),
        )
    )


# Detectors over one row of statistics per column


def implausible_range(ev: Evidence) -> DataFrame:
    found = []
    for r in ev.rows:
        if r.get("beyond"):
            label, lower, upper = plausible_range(r["column"])
            found.append(_finding(
                "implausible_range", r["column"], 0.75, r["beyond"],
                f"{r['beyond']} value(s) outside {lower:g} to {upper:g}, the plausible range for {label}",
                "flag_out_of_range", column=r["column"], lower=lower, upper=upper,
            ))
    return _relation(ev, found)


def date_like(ev: Evidence) -> DataFrame:
    found = []
    for r in ev.with_dates().rows:
        if r["kind"] != "text" or r["present"] < 5:
            continue
        rate = r["dated"] / r["present"]
        if r["shaped"] / r["present"] >= 0.85 and rate >= 0.85:
            found.append(_finding(
                "date_like", r["column"], round(min(rate, 0.95), 2), r["dated"],
                f"{rate:.0%} of values parse as dates, in about {r['shapes']} layout(s), but the column is text",
                "coerce_datetime", column=r["column"],
            ))
    return _relation(ev, found)


def numeric_like(ev: Evidence) -> DataFrame:
    found, tiny = [], None
    for r in ev.rows:
        if r["kind"] != "text" or r["present"] < 5 or r["numbers"] / r["present"] < 0.80:
            continue
        if r["distinct_sketch"] < 10:
            tiny = ev.distinct_at_most(2) if tiny is None else tiny
            if r["column"] in tiny:
                continue
        rate = r["numbers"] / r["present"]
        found.append(_finding(
            "numeric_like", r["column"], round(min(rate, 0.95), 2), r["numbers"],
            f"{rate:.0%} of values are numbers but the column is text; "
            f"{r['present'] - r['numbers']} would become blank",
            "coerce_numeric", column=r["column"],
        ))
    return _relation(ev, found)


def structural_missing(ev: Evidence, threshold: float = 0.45, skip: set[str] = frozenset()) -> DataFrame:
    found = []
    for r in ev.rows:
        blank = (r["n_rows"] - r["present"]) / r["n_rows"] if r["n_rows"] else 0.0
        if r["column"] in skip or not r["n_rows"] or blank < threshold:
            continue
        confidence = 0.90 if blank >= 0.95 else 0.75 if blank >= 0.75 else 0.55
        found.append(_finding(
            "structural_missing", r["column"], confidence, r["n_rows"] - r["present"],
            f"{blank:.1%} blank: likely a question that was not put to everyone; do not fill it in",
        ))
    return _relation(ev, found)


def constant_columns(ev: Evidence) -> DataFrame:
    names = constant_names(ev)
    if not names:
        return _relation(ev, [])
    label = ", ".join(names)
    return _relation(ev, [_finding(
        "constant_columns", label, 0.90, len(names), f"{len(names)} column(s) hold one value in every row: {label}",
        "drop_constant_columns", columns=names,
    )])


def constant_names(ev: Evidence) -> list[str]:
    """Columns with one value, blank counting as a value."""
    if ev.n_rows < 2:
        return []
    single = ev.distinct_at_most(1)
    return [
        r["column"] for r in ev.rows
        if r["present"] == 0 or (r["present"] == r["n_rows"] and r["column"] in single)
    ]


def repeated_header_row(ev: Evidence) -> DataFrame:
    if not ev.header_rows:
        return _relation(ev, [])
    return _relation(ev, [_finding(
        "repeated_header_row", TABLE, 0.95, ev.header_rows,
        f"{ev.header_rows} row(s) repeat the column headers as data", "drop_repeated_header_rows",
    )])


def multiselect_stem(name: str) -> str | None:
    for pattern in K.MULTISELECT_NAMES:
        match = re.match(pattern, name)
        if match:
            return match.group("stem")
    return None


def multiselect_groups(names: list[str]) -> dict[str, list[str]]:
    """Stem to sorted members, for questions exploded into three columns or more."""
    groups: dict[str, list[str]] = {}
    for name in names:
        stem = multiselect_stem(name)
        if stem is not None:
            groups.setdefault(stem, []).append(name)
    return {stem: sorted(members) for stem, members in sorted(groups.items()) if len(members) >= 3}


def multiselect_group(ev: Evidence) -> DataFrame:
    return _relation(ev, [
        _finding(
            "multiselect_group", stem, 0.90, sum(ev.stat(m)["present"] for m in members),
            f"{len(members)} columns are one question; blank means not ticked",
            "collapse_multiselect", stem=stem, members=members,
        )
        for stem, members in multiselect_groups(ev.columns).items()
    ])


def identifying_class(name: str) -> str | None:
    for kind, pattern in K.IDENTIFYING_NAMES.items():
        if re.search(pattern, words_of(name)):
            return kind
    return None


def pii(ev: Evidence) -> DataFrame:
    found = []
    for r in ev.rows:
        kind = identifying_class(r["column"])
        if kind == "free_text":
            found.append(_finding(
                "pii", r["column"], 0.50, r["present"],
                "Free text: read it before sharing; hashing would destroy it and protect nobody",
            ))
        elif kind:
            found.append(_finding(
                "pii", r["column"], 0.80, r["present"],
                f"The column name suggests {kind.replace('_', ' ')}; de-identify before sharing",
                "deidentify", column=r["column"], method="hash",
            ))
    return _relation(ev, found)


# Whole-table detectors with their own job


def duplicates(ev: Evidence) -> DataFrame:
    n = ev.duplicates()
    if not n:
        return _relation(ev, [])
    return _relation(ev, [_finding(
        "duplicate_rows", TABLE, 0.95, n, f"{n} exactly repeated rows ({n / ev.n_rows:.1%})", "drop_duplicates"
    )])


def two_row_header(df: DataFrame) -> DataFrame:
    """Row 0 is question wording: read the first row, and count numbers only when it looks the part.

    Without row ids no row is the first, so there is nothing to find, and nothing that could be promoted.
    """
    if ROW_ID not in df.columns:
        return local_relation(df.sparkSession, [], FINDINGS)
    top = first_row(df)
    if top is None or _wordy(top.asDict(), data_columns(df)) < 0.3:
        return local_relation(df.sparkSession, [], FINDINGS)
    texts = [c for c in data_columns(df) if is_text(df.schema[c])]
    got = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(number(named(c))).alias(f"n{i}") for i, c in enumerate(texts)]
    ).first()
    return question_text(df, top.asDict(), got["rows"], {c: got[f"n{i}"] for i, c in enumerate(texts)})


def _wordy(top: dict, names: list[str]) -> float:
    return sum(isinstance(top[c], str) and len(top[c]) > 40 for c in names) / max(len(names), 1)


def question_text(df: DataFrame, top: dict, rows: int, numbers: dict[str, int]) -> DataFrame:
    """What the first row `top` says, with the rows of the table and the numbers in each text column; `df` gives the schema."""
    names = data_columns(df)
    ratio = _wordy(top, names)
    if ratio < 0.3:
        return local_relation(df.sparkSession, [], FINDINGS)
    is_number = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
    rescued = sum(
        1 for c, n in numbers.items()
        if rows > 1 and (n - bool(top[c] is not None and is_number.fullmatch(top[c]))) / (rows - 1) > 0.8
    )
    confidence = min(0.60 + ratio * 0.3 + (rescued / max(len(names), 1)) * 0.2, 0.97)
    return local_relation(df.sparkSession, [_finding(
        "two_row_header", TABLE, confidence, 1,
        f"The first row looks like question text: {round(ratio * len(names))} of {len(names)} cells are long, "
        f"{rescued} columns would be numeric without it",
        "promote_header_row", drop_rows=1,
    )], FINDINGS)


PER_COLUMN = [
    sentinel_missing, likert_scale, value_synonyms, case_variants, implausible_range, date_like, numeric_like
]


def scan(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    """All findings, most certain first. Question text in row 0 stops everything else."""
    header = two_row_header(df)
    if not header.isEmpty():
        return header
    return findings_of(df, ev=ev)


@with_evidence
def findings_of(df: DataFrame, ev: Evidence | None = None) -> DataFrame:
    ev.with_dates()  # all measures in one pass
    members = {m for group in multiselect_groups(ev.columns).values() for m in group}
    parts = [
        repeated_header_row(ev), multiselect_group(ev), pii(ev), duplicates(ev), constant_columns(ev),
        structural_missing(ev, skip=members),
    ]
    free = ~F.col("column").isin(sorted(members)) if members else F.lit(True)
    parts += [detect(ev).filter(free) for detect in PER_COLUMN]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # A handful of rows per column: kept as a small relation so later steps do not scan the table again.
    rows = [r.asDict() for r in found.orderBy(F.desc("confidence"), "kind", "column").collect()]
    return local_relation(df.sparkSession, rows, FINDINGS)
