"""A dirty survey derived from the orders table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritsieve.functions.cells import ROW_ID
from gritsieve.relations import spread

DIRTY_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderpriority AS pr, o_orderstatus AS st,
         o_totalprice AS tp, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d
  FROM {orders}
), body AS (
  SELECT k * 10 AS row_id,
    concat('R', CAST(k AS STRING)) AS respondent_id,
    concat('Customer ', CAST(ck AS STRING)) AS respondent_name,
    CASE WHEN k % 17 = 0 THEN '999' WHEN k % 23 = 0 THEN NULL
         WHEN k % 29 = 0 THEN 'Prefer not to say'
         ELSE CAST(18 + k % 58 AS STRING) END AS age,
    CASE k % 9 WHEN 0 THEN 'Male' WHEN 1 THEN 'f' WHEN 2 THEN 'm' WHEN 3 THEN 'Female'
         WHEN 4 THEN 'Man' WHEN 5 THEN '1' WHEN 6 THEN 'Woman' WHEN 7 THEN '2' ELSE 'U' END AS gender,
    CASE k % 8 WHEN 0 THEN 'Lagos' WHEN 1 THEN 'lagos' WHEN 2 THEN '  Lagos' WHEN 3 THEN 'LAGOS'
         WHEN 4 THEN 'Kano' WHEN 5 THEN 'Oyo' WHEN 6 THEN 'Lagos' ELSE 'Rivers' END AS state,
    CASE pr WHEN '1-URGENT' THEN 'Strongly agree' WHEN '2-HIGH' THEN 'Agree'
         WHEN '3-MEDIUM' THEN 'Neutral' WHEN '4-NOT SPECIFIED' THEN 'Disagree'
         ELSE 'Strongly disagree' END AS Q1,
    CASE WHEN ck % 5 < 2 THEN 'Radio' END AS Q7_Part_1,
    CASE WHEN ck % 7 < 4 THEN 'Television' END AS Q7_Part_2,
    CASE WHEN ck % 3 = 0 THEN 'Web' END AS Q7_Part_3,
    CASE WHEN k % 20 = 0 THEN 'Often' END AS Q9_followup,
    CASE WHEN k % 31 = 0 THEN -99.0 WHEN k % 37 = 0 THEN NULL ELSE tp END AS monthly_income,
    CASE k % 4 WHEN 0 THEN d
         WHEN 1 THEN concat(substr(d,9,2),'/',substr(d,6,2),'/',substr(d,1,4))
         WHEN 2 THEN concat(substr(d,9,2),'-',substr(d,6,2),'-',substr(d,1,4))
         ELSE concat(substr(d,1,4),'/',substr(d,6,2),'/',substr(d,9,2)) END AS survey_date,
    CASE WHEN ck % 2 = 0 THEN 'Control' ELSE 'New Protocol' END AS treatment_arm,
    CASE WHEN ck % 2 = 0 AND k % 9 = 4 THEN 'Died' WHEN ck % 2 = 1 AND k % 50 = 1 THEN 'Died'
         WHEN k % 41 = 0 THEN NULL ELSE 'recovered' END AS outcome,
    'Yes' AS consent,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN 'The clinic was far'
         WHEN 4 THEN 'Nothing to add' ELSE 'Don''t know' END AS free_text_comment
  FROM base
)
SELECT * FROM body
UNION ALL
SELECT row_id + 1 AS row_id, respondent_id, respondent_name, age, gender, state, Q1, Q7_Part_1, Q7_Part_2,
       Q7_Part_3, Q9_followup, monthly_income, survey_date, treatment_arm, outcome, consent, free_text_comment
FROM body WHERE row_id % 500 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with its row_id in the library's row-id column."""
    return spark.sql(DIRTY_SQL, orders=spread(table(spark, sf_dir, "orders"))).withColumnRenamed("row_id", ROW_ID)


def dirty_cte() -> str:
    """The same view for DuckDB, where `orders` is a registered table."""
    return f"dirty AS ({DIRTY_SQL.format(orders='orders')})"
