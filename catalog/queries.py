"""Every registered query: `(spark, sf_dir) -> DataFrame` over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from catalog.dirty import DIRTY_SQL, dirty_view, table
from gritsieve.describe import charts, findings as says, questions as asks
from gritsieve.describe.roles import classify
from gritsieve.functions import cells
from gritsieve.functions.cells import ROW_ID, named
from gritsieve.operators import cleaning as ops, detectors as find, profile as prof
from gritsieve.operators.evidence import Evidence, duplicate_rows
from gritsieve.operators.registry import OPERATIONS
from gritsieve.plans import plan as planning
from gritsieve.plans.plan import Step
from gritsieve.plans.recipe import Recipe, ledger_table
from gritsieve.sources.ranking import rank_tables
from gritsieve.sources.readers import load, read_delimited, with_detected_header
from gritsieve.relations import data_columns, spread
from gritsieve.sources.scratch import fresh_path, write_once
from gritsieve.sources.sinks import write_clean, write_ledger
from gritsieve.sqlgate import run_sql
from gritsieve.streaming.clean import clean_stream, distinct_stream, scan_batches, write_stream
from gritsieve.streaming.counters import quality_counters
from gritsieve.streaming.so_far import scan_so_far

QUERIES = {}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# What the plan's unattended steps come to on the dirty view (a test compares the two).
MEMBERS = ["Q7_Part_1", "Q7_Part_2", "Q7_Part_3"]
LEVELS = ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"]
GENDER = {"1": "Male", "2": "Female", "Man": "Male", "Woman": "Female", "f": "Female", "m": "Male"}
STATE = {"  Lagos": "Lagos", "LAGOS": "Lagos", "lagos": "Lagos"}
BLANK_COMMENTS = ["", "-", "Don't know", "N/A"]
CLEANING = Recipe("dirty view", [
    Step("collapse_multiselect", {"stem": "Q7", "members": MEMBERS}),
    Step("drop_constant_columns", {"columns": ["consent"]}),
    Step("recode_sentinel_missing", {"column": "free_text_comment", "values": BLANK_COMMENTS, "to_number": False}),
    Step("recode_sentinel_missing", {"column": "age", "values": ["999", "Prefer not to say"], "to_number": True}),
    Step("recode_sentinel_missing", {"column": "monthly_income", "values": ["-99.0"], "to_number": False}),
    Step("coerce_datetime", {"column": "survey_date"}),
    Step("coerce_numeric", {"column": "age"}),
    Step("order_likert", {"column": "Q1", "order": LEVELS}),
    Step("map_categories", {"column": "gender", "mapping": GENDER}),
    Step("map_categories", {"column": "state", "mapping": STATE}),
    Step("drop_duplicates", {}),
])


_CLEANED: dict[tuple[str, str], DataFrame] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def shown(df: DataFrame) -> DataFrame:
    """Row ids under the fixture's own name."""
    return df.withColumnRenamed(ROW_ID, "row_id")


def clean_view(spark: SparkSession, sf: str) -> DataFrame:
    return CLEANING.apply(dirty_view(spark, sf))


def cleaned_table(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned view, written once per session to the shared folder: work of several passes reads only its columns."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CLEANED:
        _CLEANED[key] = write_once(clean_view(spark, sf), "cleaned")
    return _CLEANED[key]


def learned(spark: SparkSession, sf: str) -> tuple[DataFrame, Recipe]:
    """Scan, plan, keep the safe steps, resolve them: the whole path from raw table to recipe."""
    df = dirty_view(spark, sf)
    plan = planning.build_plan(find.scan(df))
    return df, Recipe.learn(df, planning.steps_of(planning.auto_apply(plan)), "dirty view")


def joined(column: str, sep: str = "|"):
    return F.array_join(F.array_sort(F.from_json(column, "array<string>")), sep)


# Cell functions


@query
def fn_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(cells.norm(F.col("text"))).alias("norm_md5"))


@query
def fn_name_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", cells.name_tokens(F.col("url")).alias("tokens"))


@query
def fn_date_shape(spark, sf):
    shape = cells.date_shape(F.col("survey_date")).alias("shape")
    return dirty_view(spark, sf).groupBy(shape).agg(F.count(F.lit(1)).alias("n"))


@query
def fn_looks_like_date(spark, sf):
    df = dirty_view(spark, sf)
    text = F.explode(F.array("survey_date", "age", "free_text_comment", F.col("monthly_income").cast("string")))
    return (
        df.select(text.alias("text")).filter("text is not null")
        .groupBy(cells.date_shape(F.col("text")).alias("shape"), cells.looks_like_date(F.col("text")).alias("is_date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def fn_number(spark, sf):
    df = dirty_view(spark, sf).select(F.explode(F.array("age", "gender", "free_text_comment", "survey_date")).alias("text"))
    return (
        df.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        .select("text", cells.number(F.col("text")).alias("number"), "n")
    )


@query
def fn_hash_prefix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", cells.hash_prefix(F.col("c_name")).alias("name_hash"))


# Cleaning operators


@query
def clean_promote_header_row(spark, sf):
    return shown(ops.promote_header_row(dirty_view(spark, sf), drop_rows=3)).select("row_id", "respondent_id")


HEADERS_SQL = """
SELECT * FROM {dirty} UNION ALL
SELECT row_id + 2 AS row_id, 'respondent_id' AS respondent_id, 'respondent_name' AS respondent_name, ' AGE ' AS age,
       'gender' AS gender, 'state' AS state, 'q1' AS Q1, 'Q7_Part_1' AS Q7_Part_1, 'Q7_Part_2' AS Q7_Part_2,
       'Q7_Part_3' AS Q7_Part_3, 'other' AS Q9_followup, monthly_income, survey_date, treatment_arm, outcome, consent,
       free_text_comment
FROM {dirty} WHERE row_id % 70 = 0
"""
EMPTY_SQL = """
SELECT * FROM {dirty} UNION ALL
SELECT row_id + 3 AS row_id, NULL AS respondent_id, NULL AS respondent_name, NULL AS age, NULL AS gender, NULL AS state,
       NULL AS Q1, NULL AS Q7_Part_1, NULL AS Q7_Part_2, NULL AS Q7_Part_3, NULL AS Q9_followup, NULL AS monthly_income,
       NULL AS survey_date, NULL AS treatment_arm, NULL AS outcome, NULL AS consent, NULL AS free_text_comment
FROM {dirty} WHERE row_id % 70 = 0
"""


def with_header_copies(spark, sf):
    return spark.sql(HEADERS_SQL, dirty=shown(dirty_view(spark, sf))).withColumnRenamed("row_id", ROW_ID)


def with_empty_rows(spark, sf):
    return spark.sql(EMPTY_SQL, dirty=shown(dirty_view(spark, sf))).withColumnRenamed("row_id", ROW_ID)


@query
def clean_drop_repeated_header_rows(spark, sf):
    return shown(ops.drop_repeated_header_rows(with_header_copies(spark, sf))).select("row_id", "age", "gender", "Q1")


@query
def clean_drop_empty_rows(spark, sf):
    return shown(ops.drop_empty_rows(with_empty_rows(spark, sf))).select("row_id", "age", "monthly_income")


@query
def clean_drop_column(spark, sf):
    return ops.drop_column(table(spark, sf, "orders"), "o_orderstatus")


@query
def clean_rename_column(spark, sf):
    return ops.rename_column(table(spark, sf, "customer"), "c_acctbal", "balance")


@query
def clean_drop_constant_columns(spark, sf):
    df = shown(ops.drop_constant_columns(dirty_view(spark, sf), ["consent", "not_there"]))
    return df.drop("free_text_comment", "survey_date")


@query
def clean_collapse_multiselect(spark, sf):
    df = ops.collapse_multiselect(dirty_view(spark, sf), "Q7", MEMBERS)
    return shown(df).select("row_id", *MEMBERS, F.col("Q7_count").cast("bigint").alias("Q7_count"), "Q7_selected")


@query
def clean_recode_sentinel_missing(spark, sf):
    df = dirty_view(spark, sf)
    df = ops.recode_sentinel_missing(df, "age", ["999", "Prefer not to say"], to_number=True)
    df = ops.recode_sentinel_missing(df, "monthly_income", [-99])
    df = ops.recode_sentinel_missing(df, "free_text_comment", BLANK_COMMENTS)
    return shown(df).select("row_id", "age", "monthly_income", "free_text_comment")


@query
def clean_order_likert(spark, sf):
    df = shown(ops.order_likert(dirty_view(spark, sf), "Q1", LEVELS))
    return df.select("row_id", "Q1", F.col("Q1__ord").cast("bigint").alias("Q1__ord"))


@query
def clean_coerce_numeric(spark, sf):
    return shown(ops.coerce_numeric(dirty_view(spark, sf), "age")).select("row_id", "age")


@query
def clean_coerce_datetime(spark, sf):
    df = dirty_view(spark, sf).withColumn("day_first", F.col("survey_date"))
    df = ops.coerce_datetime(ops.coerce_datetime(df, "survey_date"), "day_first", dayfirst=True)
    return shown(df).select("row_id", "survey_date", "day_first")


@query
def clean_strip_whitespace(spark, sf):
    return shown(ops.strip_whitespace(dirty_view(spark, sf), "state")).select("row_id", "state")


@query
def clean_map_categories(spark, sf):
    df = ops.map_categories(dirty_view(spark, sf), "gender", GENDER)
    return shown(ops.map_categories(df, "state", STATE)).select("row_id", "gender", "state")


@query
def clean_drop_duplicates(spark, sf):
    return shown(ops.drop_duplicates(dirty_view(spark, sf))).select("row_id", "respondent_id", "age", "monthly_income")


def _filled(spark, sf, method: str) -> DataFrame:
    df = ops.coerce_numeric(ops.recode_sentinel_missing(dirty_view(spark, sf), "age", ["999"]), "age")
    recipe = Recipe.learn(df, [Step("fill_missing", {"column": "age", "method": method})])
    return shown(recipe.apply(df)).select("row_id", F.round("age", 6).alias("age"))


@query
def clean_fill_missing_median(spark, sf):
    return _filled(spark, sf, "median")


@query
def clean_fill_missing_mean(spark, sf):
    return _filled(spark, sf, "mean")


@query
def clean_fill_missing_mode(spark, sf):
    return _filled(spark, sf, "mode")


@query
def clean_fill_missing_constant(spark, sf):
    return shown(ops.fill_missing(dirty_view(spark, sf), "outcome", "constant", "unknown")).select("row_id", "outcome")


@query
def clean_clip_outliers(spark, sf):
    df = ops.clip_outliers(ops.coerce_numeric(dirty_view(spark, sf), "age"), "age", 20, 70)
    return shown(ops.clip_outliers(df, "monthly_income", 0.0, 300000.0)).select("row_id", "age", "monthly_income")


@query
def clean_flag_out_of_range(spark, sf):
    df = ops.flag_out_of_range(ops.coerce_numeric(dirty_view(spark, sf), "age"), "age", 0, 120)
    return shown(df).select("row_id", "age", "age_out_of_range")


@query
def clean_flag_date_order(spark, sf):
    """Orders joined to their lines: shipped before ordered."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    df = ops.flag_date_order(lines.join(orders, "l_orderkey"), "o_orderdate", "l_shipdate")
    return df.groupBy("l_shipdate_before_o_orderdate").agg(F.count(F.lit(1)).alias("n"))


@query
def clean_deidentify(spark, sf):
    df = ops.deidentify(dirty_view(spark, sf), "respondent_id")
    return shown(ops.deidentify(df, "respondent_name", "drop")).select("row_id", "respondent_id", "age")


# Profile and score


def _flat_profile(df: DataFrame) -> DataFrame:
    out = prof.profile(df, samples=prof.SAMPLE if ROW_ID in df.columns else 0)
    if "sample" in out.columns:
        out = out.withColumn("sample", F.array_join("sample", "|"))
    return out.withColumn("pct_missing", F.round("pct_missing", 9)).drop("pos", "type")


@query
def profile_columns(spark, sf):
    return _flat_profile(dirty_view(spark, sf))


@query
def profile_orders(spark, sf):
    return _flat_profile(table(spark, sf, "orders"))


@query
def profile_lineitem(spark, sf):
    return _flat_profile(table(spark, sf, "lineitem"))


@query
def profile_documents(spark, sf):
    return _flat_profile(table(spark, sf, "documents"))


@query
def profile_embeddings(spark, sf):
    """An array column must not break the profile; its cells are compared as text."""
    return _flat_profile(table(spark, sf, "embeddings"))


@query
def duplicate_count(spark, sf):
    return duplicate_rows(dirty_view(spark, sf))


@query
def score_breakdown(spark, sf):
    return prof.score_breakdown(dirty_view(spark, sf)).withColumn("n_cols", F.col("n_cols").cast("bigint"))


@query
def quality_score(spark, sf):
    return prof.quality_score(dirty_view(spark, sf)).select(F.col("score").cast("bigint").alias("score"))


@query
def scorecard(spark, sf):
    return prof.scorecard(dirty_view(spark, sf), cleaned_table(spark, sf))


@query
def schema_summary(spark, sf):
    out = prof.schema_summary(cleaned_table(spark, sf))
    return out.select("column", "is_ordered", F.array_join("levels", "|").alias("levels"))


# Detectors


def _found(found: DataFrame, extra: dict | None = None) -> DataFrame:
    return found.select("kind", "column", "confidence", "n_affected", "op", *[
        c.alias(name) for name, c in (extra or {}).items()
    ])


def _param(name: str):
    return F.get_json_object("params", f"$.{name}")


def _pairs():
    entries = F.map_entries(F.from_json(_param("mapping"), "map<string,string>"))
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("=>"), e["value"]))), "|")


QUESTION_TEXT_SQL = """
SELECT o_orderkey + 1 AS row_id, CAST(o_orderkey AS STRING) AS Q1, o_orderpriority AS Q2 FROM {orders} UNION ALL
SELECT 0 AS row_id, max('What is the number of the order placed by the customer?') AS Q1,
       max('Which priority was given to the order when it was placed?') AS Q2 FROM {orders}
"""


@query
def detect_two_row_header(spark, sf):
    df = spark.sql(QUESTION_TEXT_SQL, orders=table(spark, sf, "orders")).withColumnRenamed("row_id", ROW_ID)
    return find.two_row_header(df).select("kind", "column", F.round("confidence", 6).alias("confidence"), "n_affected", "op")


@query
def detect_sentinel_missing(spark, sf):
    return _found(find.sentinel_missing(Evidence(dirty_view(spark, sf))), {"values": joined(_param("values"))})


@query
def detect_likert_scale(spark, sf):
    levels = F.array_join(F.from_json(_param("order"), "array<string>"), "|")
    return _found(find.likert_scale(Evidence(dirty_view(spark, sf))), {"order": levels})


@query
def detect_value_synonyms(spark, sf):
    return _found(find.value_synonyms(Evidence(dirty_view(spark, sf))), {"mapping": _pairs()})


@query
def detect_case_variants(spark, sf):
    return _found(find.case_variants(Evidence(dirty_view(spark, sf))), {"mapping": _pairs()})


@query
def detect_repeated_header_row(spark, sf):
    return _found(find.repeated_header_row(Evidence(with_header_copies(spark, sf))))


@query
def detect_repeated_header_row_wide(spark, sf):
    """Header copies in a table of 600 columns."""
    wide = spread(table(spark, sf, "customer")).select(F.col("c_custkey").alias(ROW_ID), *[
        F.when(F.col("c_custkey") % 50 == 0, F.lit(f"W{i}")).otherwise(F.col("c_name")).alias(f"w{i}") for i in range(600)
    ])
    return _found(find.repeated_header_row(Evidence(wide)))


@query
def duplicate_count_floats(spark, sf):
    """NaN and blank are one value, and so are both zeros."""
    v = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 3, F.lit(-0.0)).when(
        F.col("l_linenumber") == 4, F.lit(0.0)).when(F.col("l_linenumber") > 4, F.col("l_quantity").cast("double"))
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", v.alias("v"))
    kept = ops.drop_duplicates(df).agg(F.count(F.lit(1)).alias("n_kept"))
    return duplicate_rows(df).withColumn("n_kept", kept.scalar())


@query
def auto_apply_real_values(spark, sf):
    """An age column with a sure code (999) and real values that are doubtful codes (77, 88, 98, 99)."""
    age = F.when(F.col("o_orderkey") % 10 == 0, 999).otherwise(18 + F.col("o_orderkey") % 85)
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(ROW_ID), age.cast("int").alias("age"))
    sure = [s for s in planning.steps_of(planning.auto_apply(planning.build_plan(find.scan(df)))) if s.op == "recode_sentinel_missing"]
    return Recipe.learn(df, sure).apply(df).groupBy(F.col("age").cast("bigint").alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query
def detect_duplicate_rows(spark, sf):
    return _found(find.duplicates(Evidence(dirty_view(spark, sf))))


@query
def detect_constant_columns(spark, sf):
    return _found(find.constant_columns(Evidence(dirty_view(spark, sf))))


@query
def detect_implausible_range(spark, sf):
    df = ops.coerce_numeric(dirty_view(spark, sf), "age")
    return _found(find.implausible_range(Evidence(df)), {
        "lower": _param("lower").cast("double"), "upper": _param("upper").cast("double")
    })


@query
def detect_date_like(spark, sf):
    return _found(find.date_like(Evidence(dirty_view(spark, sf))))


@query
def detect_numeric_like(spark, sf):
    return _found(find.numeric_like(Evidence(dirty_view(spark, sf))))


@query
def detect_multiselect_group(spark, sf):
    return _found(find.multiselect_group(Evidence(dirty_view(spark, sf))), {"members": joined(_param("members"))})


@query
def detect_pii(spark, sf):
    return _found(find.pii(Evidence(dirty_view(spark, sf))))


@query
def detect_structural_missing(spark, sf):
    ev = Evidence(dirty_view(spark, sf))
    return _found(find.structural_missing(ev, skip=set(MEMBERS)))


@query
def scan(spark, sf):
    return _found(find.scan(dirty_view(spark, sf)))


@query
def scan_customers(spark, sf):
    """The scan on a table of another kind, without a row order."""
    return _found(find.scan(table(spark, sf, "customer")))


# Plan and recipe


def _plan(spark, sf) -> DataFrame:
    return planning.build_plan(find.scan(dirty_view(spark, sf)))


@query
def plan(spark, sf):
    return _plan(spark, sf).select(
        F.col("step").cast("bigint").alias("step"), F.col("stage").cast("bigint").alias("stage"), "stage_label", "op",
        "target", "confidence", F.col("blocked").isNotNull().alias("is_blocked"),
    )


@query
def never_impute(spark, sf):
    return planning.never_impute(find.scan(dirty_view(spark, sf)))


@query
def plan_blocked(spark, sf):
    """Proposals the guards refuse, added to the scan's own: fills of protected columns, bounds, rival coercions."""
    found = find.scan(dirty_view(spark, sf))
    kind = "kind", "column", "confidence", "n_affected", "detail"
    fills = found.filter("kind in ('structural_missing', 'sentinel_missing')").select(
        *kind, F.lit("fill_missing").alias("op"),
        F.to_json(F.struct("column", F.lit("mode").alias("method"))).alias("params"),
    )
    clips = found.filter("kind = 'numeric_like'").select(
        *kind, F.lit("clip_outliers").alias("op"),
        F.to_json(F.struct("column", F.lit(120).alias("lower"), F.lit(0).alias("upper"))).alias("params"),
    )
    rivals = found.filter("kind in ('date_like', 'numeric_like')").select(
        "kind", "column", F.lit(0.86).alias("confidence"), "n_affected", "detail",
        F.when(F.col("op") == "coerce_numeric", "coerce_datetime").otherwise("coerce_numeric").alias("op"),
        F.to_json(F.struct("column")).alias("params"),
    )
    plan_ = planning.build_plan(found.union(fills).union(clips).union(rivals))
    return plan_.filter("blocked is not null").select(
        F.col("stage").cast("bigint").alias("stage"), "op", "target", "confidence"
    )


@query
def auto_apply(spark, sf):
    return planning.auto_apply(_plan(spark, sf)).select("op", "target", "confidence")


@query
def order_violations(spark, sf):
    """The scan's proposals run by confidence alone: which of them come too late."""
    found = find.scan(dirty_view(spark, sf)).filter("op is not null")
    seq = F.row_number().over(W.orderBy(F.desc("confidence"), "kind", "column"))
    out = planning.order_violations(found.select(seq.alias("seq"), "op"))
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in ("seq", "stage", "after_stage")], "op", "after_op")


@query
def cautions(spark, sf):
    filled = [Step("fill_missing", {"column": "age", "method": "median"})]
    return planning.cautions(find.scan(dirty_view(spark, sf)), filled).select("kind", "column")


@query
def replay_from_json(spark, sf):
    """The recipe written as JSON and read back, without its last step."""
    recipe = Recipe.from_json(CLEANING.steps_json()).undo()
    out = shown(recipe.apply(dirty_view(spark, sf)))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("Q1__ord", "Q7_count")})


@query
def sink_clean(spark, sf):
    """The cleaned table written as CSV by the sink and loaded again: texts and numbers of a few columns."""
    path = fresh_path(spark, "sink") + ".csv"
    write_clean(cleaned_table(spark, sf), path)
    back = load(spark, path).df
    return back.select("respondent_id", "gender", "state", F.col("age").cast("double").alias("age"), "Q1")


@query
def sink_ledger(spark, sf):
    path = fresh_path(spark, "ledger")
    write_ledger(CLEANING.ledger(dirty_view(spark, sf)), path)
    back = spark.read.json(path)
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in ("seq", "rows_before", "rows_after", "rows_affected")], "op")


@query
def replay_clean(spark, sf):
    df, recipe = learned(spark, sf)
    out = shown(recipe.apply(df))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("Q1__ord", "Q7_count")})


@query
def ledger(spark, sf):
    df, recipe = learned(spark, sf)
    return recipe.ledger(df).select(
        F.col("seq").cast("bigint").alias("seq"), "op", "rows_before", "rows_after", "rows_affected",
        F.col("cols_before").cast("bigint").alias("cols_before"), F.col("cols_after").cast("bigint").alias("cols_after"),
    )


@query
def ledger_for_reading(spark, sf):
    df = dirty_view(spark, sf)
    return ledger_table(CLEANING.ledger(df)).select(
        F.col("seq").cast("bigint").alias("seq"), "operation", "rows_affected", "shape"
    )


# Roles, chart data, chart suggestions


@query
def roles(spark, sf):
    return classify(cleaned_table(spark, sf)).select(F.col("pos").cast("bigint").alias("pos"), "column", "role")


@query
def chart_suggestions(spark, sf):
    out = charts.suggest_charts(cleaned_table(spark, sf))
    return out.select(F.col("place").cast("bigint").alias("place"), "kind", "title", "score")


def _bins(df: DataFrame) -> DataFrame:
    return df.select(F.col("bin").cast("bigint").alias("bin"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query
def chart_histogram(spark, sf):
    return _bins(charts.histogram(cleaned_table(spark, sf), "monthly_income"))


@query
def chart_histogram_lineitem(spark, sf):
    return _bins(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@query
def chart_likert_bar(spark, sf):
    return charts.likert_bar(clean_view(spark, sf), "Q1").withColumn("place", F.col("place").cast("bigint"))


@query
def chart_category_bar(spark, sf):
    return charts.category_bar(clean_view(spark, sf), "state")


@query
def chart_category_bar_parts(spark, sf):
    return charts.category_bar(table(spark, sf, "part"), "p_type")


@query
def chart_timeseries(spark, sf):
    return charts.timeseries(clean_view(spark, sf), "survey_date")


@query
def chart_timeseries_events(spark, sf):
    return charts.timeseries(table(spark, sf, "events"), "ts")


@query
def chart_grouped_bar(spark, sf):
    return charts.grouped_bar(cleaned_table(spark, sf), "gender", "Q1").withColumn("pct", F.round("pct", 6))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in names})


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query
def chart_box_by_group(spark, sf):
    return _rounded(charts.box_by_group(cleaned_table(spark, sf), "state", "monthly_income"), *BOX)


@query
def chart_box_lineitem(spark, sf):
    return _rounded(charts.box_by_group(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), *BOX)


@query
def chart_scatter(spark, sf):
    return charts.scatter(clean_view(spark, sf), "age", "monthly_income")


@query
def chart_missingness(spark, sf):
    return charts.missingness(clean_view(spark, sf)).withColumn("pct", F.round("pct", 6))


# Descriptive findings


@query
def finding_completeness(spark, sf):
    out = says.completeness(clean_view(spark, sf))
    return out.select("records", F.col("fields").cast("bigint").alias("fields"), F.round("filled_share", 9).alias("filled_share"))


@query
def finding_thin_fields(spark, sf):
    return says.thin_fields(clean_view(spark, sf))


@query
def finding_outcome_split(spark, sf):
    return says.outcome_split(cleaned_table(spark, sf), "outcome")


@query
def finding_bad_value(spark, sf):
    return says.bad_value(clean_view(spark, sf), "outcome")


@query
def finding_group_rates(spark, sf):
    return says.group_rates(cleaned_table(spark, sf), "outcome", "treatment_arm")


@query
def finding_group_gap(spark, sf):
    return says.group_gap(cleaned_table(spark, sf), "outcome", "treatment_arm")


@query
def finding_concentration(spark, sf):
    return says.concentration(cleaned_table(spark, sf), "state").withColumn("share", F.round("share", 9))


@query
def finding_numeric_summary(spark, sf):
    return _rounded(says.numeric_summary(cleaned_table(spark, sf), "monthly_income"), "median", "q1", "q3", "mean")


@query
def finding_numeric_summary_lineitem(spark, sf):
    return _rounded(says.numeric_summary(table(spark, sf, "lineitem"), "l_extendedprice"), "median", "q1", "q3", "mean")


@query
def findings(spark, sf):
    out = says.analyse(cleaned_table(spark, sf))
    names = F.array_join(F.from_json("columns", "array<string>"), "|")
    return out.select("kind", names.alias("columns"), F.round("importance", 6).alias("importance"))


@query
def finding_headlines(spark, sf):
    """The words and numbers of three kinds of findings."""
    return says.analyse(cleaned_table(spark, sf)).where("kind in ('completeness', 'outcome_split', 'concentration')").select("headline", "detail")


@query
def recommendations(spark, sf):
    df = cleaned_table(spark, sf)
    ev = Evidence(df)
    try:
        out = says.recommendations(df, says.analyse(df, ev=ev), ev)
    finally:
        ev.close()
    subject = F.when(F.col("kind") == "investigate_gap", F.array_join(F.from_json("subject", "array<string>"), "|"))
    return out.select(F.col("place").cast("bigint").alias("place"), "kind", F.coalesce(subject, "subject").alias("subject"))


# Questions


@query
def questions(spark, sf):
    out = asks.suggest_questions(cleaned_table(spark, sf))
    return out.select(F.col("place").cast("bigint").alias("place"), "question", "score", "category")


@query
def question_outcome_by_exposure(spark, sf):
    return asks.shares_by_group(cleaned_table(spark, sf), "treatment_arm", "outcome").withColumn("pct", F.round("pct", 6))


@query
def question_outcome_by_group(spark, sf):
    return asks.shares_by_group(cleaned_table(spark, sf), "gender", "outcome").withColumn("pct", F.round("pct", 6))


@query
def question_records_per_outcome(spark, sf):
    return asks.records_by_value(clean_view(spark, sf), "outcome")


@query
def question_median_by_group(spark, sf):
    return _rounded(asks.median_by_group(cleaned_table(spark, sf), "monthly_income", "treatment_arm"), "median")


@query
def question_median_level(spark, sf):
    return asks.median_level(clean_view(spark, sf), "Q1", "gender").withColumn("place", F.col("place").cast("bigint"))


@query
def question_mean_and_median(spark, sf):
    return _rounded(asks.mean_median_by_group(cleaned_table(spark, sf), "age", "gender"), "mean", "median")


@query
def question_spread(spark, sf):
    return _rounded(asks.spread(cleaned_table(spark, sf), "monthly_income"), "minimum", "q1", "median", "q3", "maximum")


@query
def question_records_by_month(spark, sf):
    return asks.records_by_month(clean_view(spark, sf), "survey_date", "gender")


@query
def question_records_by_category(spark, sf):
    return asks.known_records_by_value(clean_view(spark, sf), "gender")


# SQL over the table

READONLY_SQL = """
WITH t AS (SELECT state, gender, monthly_income FROM data WHERE monthly_income IS NOT NULL) -- cleaned rows
SELECT state, gender, count(*) AS n, max(monthly_income) AS most FROM t GROUP BY state, gender
"""


@query
def sql_readonly(spark, sf):
    return run_sql(clean_view(spark, sf), READONLY_SQL)


@query
def sql_pipe(spark, sf):
    """A query in pipe syntax with a recursive list, over the table as it is given."""
    return run_sql(table(spark, sf, "orders"), """
        WITH RECURSIVE level(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM level WHERE n < 5)
        FROM data |> WHERE o_orderstatus <> 'P' |> EXTEND CAST(substring(o_orderpriority, 1, 1) AS INT) AS n |> JOIN level USING (n)
        |> AGGREGATE count(*) AS orders, max(o_totalprice) AS most GROUP BY n, o_orderstatus
    """).select(F.col("n").cast("bigint").alias("n"), "o_orderstatus", "orders", F.col("most").cast("double").alias("most"))


# Sources: Spark writes the given tables in another format, the readers read them back


@query
def load_delimited(spark, sf):
    path = fresh_path(spark, "dirty") + ".csv"
    dirty_view(spark, sf).drop(ROW_ID).write.options(
        header=True, escape='"', sep=";", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return load(spark, path).df.drop(ROW_ID).drop("monthly_income")


@query
def load_multiline(spark, sf):
    """Texts with line breaks, quotes and separators in their cells."""
    path = fresh_path(spark, "documents") + ".csv"
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.options(header=True, escape='"', quoteAll=True).csv(path)
    return load(spark, path).df.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query
def load_names(spark, sf):
    """A header with blanks around names, names that differ in case only, and one name twice."""
    path = fresh_path(spark, "names") + ".csv"
    lines = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey", F.upper("n_name")))
    head = spark.createDataFrame([(" key ,name,key,NAME",)], "line string")
    head.union(lines).coalesce(1).write.text(path)
    got = load(spark, path)
    noted = F.lit(len([n for n in got.notes if "earlier" in n])).cast("bigint")
    return got.df.select(*[named(c).alias(f"{i}_{c}") for i, c in enumerate(data_columns(got.df))], noted.alias("notes"))


@query
def load_json_lines(spark, sf):
    path = fresh_path(spark, "orders") + ".json"
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.struct("o_custkey", F.struct("o_orderstatus").alias("state")).alias("by"), "o_totalprice"
    )
    orders.write.json(path)
    return load(spark, path).df.drop(ROW_ID)


@query
def load_with_title_block(spark, sf):
    """A headerless export whose first rows are a title block: the header row is found and used."""
    path = fresh_path(spark, "titled")
    customers = table(spark, sf, "customer").select(*[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_mktsegment")])
    customers.withColumn("pad", F.lit(None).cast("string")).write.parquet(path)
    body = spark.read.parquet(path)
    body = body.select((F.col("c_custkey").cast("bigint") + 10).alias(ROW_ID), *body.columns)
    top = customers.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("i"), F.concat(F.lit("Customers: "), "n").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")),
            F.struct(F.lit(1).alias("i"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c")),
            F.struct(F.lit(2).alias("i"), F.lit("key").alias("a"), F.lit("name").alias("b"), F.lit("segment").alias("c")),
        )).alias("r")
    ).select(F.col("r.i").cast("bigint").alias(ROW_ID), "r.a", "r.b", "r.c", F.lit(None).cast("string").alias("pad"))
    raw = top.union(body).toDF(ROW_ID, "_c0", "_c1", "_c2", "_c3")
    return with_detected_header(raw).df.drop(ROW_ID)


@query
def rank_candidate_tables(spark, sf):
    return rank_tables({name: table(spark, sf, name) for name in TABLES}).withColumn(
        "n_cols", F.col("n_cols").cast("bigint")
    ).withColumn("score", F.round("score", 4))


# Streams



def _streamed(spark, sf, name):
    """The table as a stream of files; the pattern matches a single file and a folder alike."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _drained(spark, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what there is into files, and read them."""
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, label + "-checkpoint")
    write_stream(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_clean(spark, sf):
    dirty = spark.sql(DIRTY_SQL, orders=_streamed(spark, sf, "orders")).withColumnRenamed("row_id", ROW_ID)
    out = shown(_drained(spark, clean_stream(dirty, CLEANING), "stream-clean"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("Q1__ord", "Q7_count")})


@query
def stream_distinct(spark, sf):
    """Repeated events of one user and kind, however far apart, within a watermark wider than the table."""
    events = _streamed(spark, sf, "events")
    out = distinct_stream(events, "ts", "3650 days", ["event_type", "user_id"])
    return _drained(spark, out.select("event_type", "user_id"), "stream-distinct")


@query
def stream_quality_window(spark, sf):
    """Counters per day and column; the last open windows are closed by the batch that reads the rest."""
    events = _streamed(spark, sf, "events").withColumnRenamed("value", "rate").select("ts", "event_type", "user_id", "rate")
    counters = quality_counters(events, "ts", "1 day", delay="0 seconds")
    path, checkpoint = fresh_path(spark, "windows"), fresh_path(spark, "windows-checkpoint")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    started = counters.writeStream.outputMode("update").foreachBatch(keep)
    started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    latest = W.partitionBy("window_start", "column").orderBy(F.desc("b"))
    out = spark.read.parquet(path).withColumn("place", F.row_number().over(latest)).filter("place = 1")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "column", "n_rows", "n_blank", "n_codes", "n_beyond"
    )


@query
def stream_scan(spark, sf):
    """The scan of every micro-batch of the dirty survey."""
    dirty = spark.sql(DIRTY_SQL, orders=_streamed(spark, sf, "orders")).withColumnRenamed("row_id", ROW_ID)
    path, checkpoint = fresh_path(spark, "stream-scan"), fresh_path(spark, "stream-scan-checkpoint")
    scan_batches(dirty, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select(F.col("batch_id").cast("bigint").alias("batch_id"), "kind", "column", "confidence", "n_affected")


@query
def stream_scan_so_far(spark, sf):
    """The dirty survey in four micro-batches: what is known after the last is what a scan of the whole would say."""
    source = fresh_path(spark, "orders-parts")
    orders = table(spark, sf, "orders")
    orders.repartition(4, "o_orderkey").write.parquet(source)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream = stream.repartition(2 * spark.sparkContext.defaultParallelism)  # a file may hold rows enough for every core
    dirty = spark.sql(DIRTY_SQL, orders=stream).withColumnRenamed("row_id", ROW_ID)
    path, state, checkpoint = (fresh_path(spark, f"so-far-{part}") for part in ("found", "state", "checkpoint"))
    scan_so_far(dirty, path, state, checkpoint).awaitTermination()
    found = spark.read.parquet(path)
    last = found.agg(F.max("batch_id")).scalar()
    return _found(found.where(F.col("batch_id") == last).drop("batch_id"))
