"""A product table derived from lineitem, by the same SQL text in Spark and in the checking engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCTS_SQL = """
SELECT product_id,
  CASE k WHEN 2 THEN CAST(3.7 AS DOUBLE)*kc-10 WHEN 3 THEN CAST(4.7 AS DOUBLE)*kc+10
         WHEN 4 THEN CAST(3912 + h % 1000 AS DOUBLE) WHEN 20 THEN NULL ELSE kj END AS energy_kj,
  CASE k WHEN 13 THEN CAST(0.7 AS DOUBLE)*kj-10 WHEN 14 THEN CAST(1.3 AS DOUBLE)*kj+10 ELSE kj END
    AS energy_kj_computed,
  CASE k WHEN 1 THEN kj+10 ELSE kc END AS energy_kcal,
  CASE k WHEN 7 THEN CAST(106 + h % 20 AS DOUBLE) ELSE f END AS fat,
  CASE k WHEN 5 THEN f+2 WHEN 8 THEN CAST(110 AS DOUBLE) ELSE f/2 END AS saturated_fat,
  CASE k WHEN 9 THEN CAST(120 AS DOUBLE) ELSE c END AS carbohydrates,
  CASE k WHEN 10 THEN CAST(108 AS DOUBLE) ELSE c/2 END AS sugars,
  CASE k WHEN 6 THEN c WHEN 0 THEN NULL ELSE c/4 END AS starch,
  CAST(h % 15 AS DOUBLE)/10 AS sodium,
  CASE k WHEN 15 THEN '' ELSE 'Water, sugar.' END AS ingredients_text,
  CASE k WHEN 15 THEN 0 ELSE 1 END AS ingredients_text_present,
  CASE WHEN k IN (15,16) THEN 1 ELSE 0 END AS contains_statement_present,
  CASE k WHEN 15 THEN 1 WHEN 16 THEN 0 ELSE CAST(h % 2 AS INT) END AS allergen_evidence_present,
  CASE WHEN k IN (17,19) THEN 1 ELSE 0 END AS fop_threshold_exceeded,
  CASE WHEN k IN (18,19) THEN 1 ELSE 0 END AS fop_symbol_present,
  CASE k WHEN 19 THEN 1 ELSE 0 END AS fop_exempt_proxy,
  CASE k WHEN 20 THEN 0 ELSE 1 END AS product_is_prepackaged_proxy,
  CASE k WHEN 11 THEN '  ' ELSE 'en' END AS lc,
  CASE k WHEN 12 THEN NULL ELSE 'en' END AS lang,
  CASE k WHEN 11 THEN '' ELSE 'en' END AS language_code
FROM (
  SELECT product_id, h, h % 21 AS k,
         CAST(20 + h % 800 AS DOUBLE) AS kc,
         CAST(20 + h % 800 AS DOUBLE) * CAST(4.184 AS DOUBLE) AS kj,
         CAST(10 + h % 80 AS DOUBLE) AS f,
         CAST(10 + h % 85 AS DOUBLE) AS c
  FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CAST(CAST(l_shipdate AS DATE) AS STRING)) AS product_id,
           l_orderkey*31 + l_partkey*7 + l_suppkey*3 + l_linenumber AS h
    FROM {lineitem}) b) n
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRODUCTS_SQL, lineitem=table(spark, sf_dir, "lineitem"))


P_CTE = "p AS (" + PRODUCTS_SQL.replace("{lineitem}", "lineitem") + ")"
