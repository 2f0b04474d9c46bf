"""Sources, sinks and extraction."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions import text as X
from rulemill.registry import query
from rulemill.registry.adapter import P_CTE, products, table
from rulemill.schemas import NUMBER_COLUMNS, PRODUCT_COLUMNS
from rulemill.session import TEXT_FILES, new_path
from rulemill.sources import ingest as I

PRODUCT_SQL = f"WITH {P_CTE} SELECT * FROM p"

# Raw documents made from the products; extracting them must give the products back, but for the
# columns that the extraction computes itself.

def numbered(spark, sf_dir):
    """Products with a number n that only depends on the row."""
    return products(spark, sf_dir).withColumn("n", F.expr(N_SQL))


# the number is taken from the id text, the same way in both engines
N_SQL = "CAST(split_part(product_id, '-', 1) AS BIGINT) + CAST(split_part(product_id, '-', 2) AS BIGINT) * 5"
N_CTE = f"{P_CTE}, q AS (SELECT *, {N_SQL} AS n FROM p)"


def raw_documents(spark, sf_dir):
    """One JSON text per product in the raw layout, with junk lines in between."""
    p = numbered(spark, sf_dir)
    amount = {name: F.col(name).cast("string") for name in NUMBER_COLUMNS}
    even = F.col("n") % 2 == 0
    foods = F.map_concat(
        F.map_from_arrays(
            F.array(*[F.when(even, F.lit(keys[0])).otherwise(F.lit(keys[-1])) for keys in I.NUTRIENT_KEYS.values()]),
            F.array(*[F.when(F.col("n") % 7 == 0, F.concat(F.lit(" "), amount[name])).otherwise(amount[name])
                      for name in I.NUTRIENT_KEYS])),
        F.map_from_arrays(F.array(F.lit("salt_100g")), F.array(F.lit("9"))))
    doc = F.struct(
        F.when(F.col("n") % 3 == 0, F.col("product_id")).when(F.col("n") % 3 == 1, F.lit("")).alias("code"),
        F.when(F.col("n") % 3 == 1, F.col("product_id")).when(F.col("n") % 3 == 2, F.lit("")).alias("_id"),
        F.concat(F.lit(" "), F.col("product_id"), F.lit(" ")).alias("id"),
        foods.alias("nutriments"), "lc", "lang",
        F.concat(F.lit("  "), F.col("ingredients_text"), F.lit("\t")).alias("ingredients_text"),
        F.when((F.col("contains_statement_present") == 1) & even, F.lit("milk")).otherwise(F.lit("")).alias("allergens"),
        F.when((F.col("contains_statement_present") == 1) & ~even,
               F.array(F.lit("en:milk"))).otherwise(F.array().cast("array<string>")).alias("allergens_tags"),
        F.when(F.col("allergen_evidence_present") == 1, F.lit("soy")).alias("allergens_from_ingredients"),
        F.when(F.col("fop_symbol_present") == 1, F.array(F.lit("en:organic"), F.lit("CA:High-In-Sodium"))).otherwise(
            F.array(F.lit("en:organic"))).alias("labels_tags"),
        F.when(F.col("fop_exempt_proxy") == 1, F.array(F.lit("en:beverages"), F.lit("en:Waters"))).alias(
            "categories_tags"),
    )
    line = F.to_json(doc)
    junk = F.when(F.col("n") % 11 == 0, F.array(
        line, F.lit(""), F.lit("[1, 2]"), F.lit('{"code": "broken", '), F.lit('{"nutriments": {"fat": 1}}'),
        F.concat(line, F.lit(" trailing")))).otherwise(F.array(line))
    return p.select(F.explode(junk).alias("value"))


_EXTRACTED_SQL = f"""WITH {P_CTE}
SELECT product_id, energy_kj, energy_kj_computed, energy_kcal, fat, saturated_fat, carbohydrates, sugars, starch, sodium,
  ingredients_text, CASE WHEN ingredients_text <> '' THEN 1 ELSE 0 END AS ingredients_text_present,
  contains_statement_present, greatest(contains_statement_present, allergen_evidence_present)
    AS allergen_evidence_present,
  CASE WHEN sugars >= 15 OR saturated_fat >= 6 OR sodium >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END
    AS fop_threshold_exceeded,
  fop_symbol_present, fop_exempt_proxy, 1 AS product_is_prepackaged_proxy, lc, lang,
  CASE WHEN lc IS NULL OR lc = '' THEN lang ELSE lc END AS language_code FROM p"""


def _extracted(*columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM ({_EXTRACTED_SQL}) e"


@query("normalize_products", _EXTRACTED_SQL)
def normalize_products(spark, sf_dir):
    return I.extract_products(raw_documents(spark, sf_dir))


def _part(name: str, *columns: str):
    @query(name, _extracted("product_id", *columns))
    def run(spark, sf_dir):
        return I.extract_products(raw_documents(spark, sf_dir)).select("product_id", *columns)


_part("extract_product_id")
_part("extract_nutrients", *NUMBER_COLUMNS)
_part("language_code_coalesce", "lc", "lang", "language_code")
_part("ingredients_text_flags", "ingredients_text", "ingredients_text_present")
_part("allergen_flags", "contains_statement_present", "allergen_evidence_present")
_part("label_symbol_flag", "fop_symbol_present")
_part("category_exempt_flag", "fop_exempt_proxy")
_part("fop_threshold_flag", "fop_threshold_exceeded")


@query("sodium_from_salt", f"""WITH {N_CTE} SELECT product_id,
  CASE WHEN n % 2 = 0 THEN sodium ELSE round(sodium * CAST(0.393 AS DOUBLE), 4) END AS sodium FROM q""")
def sodium_from_salt(spark, sf_dir):
    p = numbered(spark, sf_dir)
    amount, even = F.col("sodium").cast("string"), F.col("n") % 2 == 0
    names = (*I.NUTRIENT_KEYS["sodium"], *I.SALT_KEYS)
    given = {"sodium": F.when(even, amount), "salt": F.when(~even, amount)}
    food = F.struct(*[given.get(k, F.lit(None).cast("string")).alias(k) for k in names])
    return p.select("product_id", I.sodium_or_salt(
        I.nutrient(food, I.NUTRIENT_KEYS["sodium"]), I.nutrient(food, I.SALT_KEYS)).alias("sodium"))


_NUMBER_TEXTS = ("CASE n % 9 WHEN 0 THEN concat(' ', n, ' ') WHEN 1 THEN concat(n, 'd') WHEN 2 THEN concat(n, '.5')"
                 " WHEN 3 THEN '' WHEN 4 THEN 'true' WHEN 5 THEN concat('-', n, 'e1') WHEN 6 THEN 'NaN'"
                 " WHEN 7 THEN concat('1_', n % 1000 + 1000) ELSE NULL END")
_NUMBER_VALUES = ("CASE n % 9 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 2 THEN n + CAST(0.5 AS DOUBLE)"
                  " WHEN 5 THEN CAST(n AS DOUBLE) * -10 WHEN 7 THEN CAST(10000 + n % 1000 + 1000 AS DOUBLE) END")


@query("to_float_tolerant", f"WITH {N_CTE} SELECT product_id, {_NUMBER_VALUES} AS amount FROM q")
def to_float_tolerant(spark, sf_dir):
    p = numbered(spark, sf_dir).withColumn("t", F.expr(_NUMBER_TEXTS))
    return p.select("product_id", X.to_number(F.col("t")).alias("amount"))


@query("first_number", f"""WITH {N_CTE}
SELECT product_id, coalesce({_NUMBER_VALUES}, CAST(n % 100 AS DOUBLE)) AS amount FROM q""")
def first_number(spark, sf_dir):
    p = numbered(spark, sf_dir).withColumn("t", F.expr(_NUMBER_TEXTS))
    return p.select("product_id", X.first_number(
        F.col("t"), F.lit("n/a"), (F.col("n") % 100).cast("string")).alias("amount"))


# ---- sources and sinks: write, read back, compare --------------------------------------------

@query("scan_products_jsonl", PRODUCT_SQL)
def scan_products_jsonl(spark, sf_dir):
    path = new_path(spark, "products-jsonl")
    I.write_jsonl(products(spark, sf_dir), path)
    return I.scan_products_jsonl(spark, path)


@query("write_jsonl", f"WITH {P_CTE} SELECT count(*) AS lines, count(DISTINCT product_id) AS ids FROM p")
def write_jsonl(spark, sf_dir):
    path = new_path(spark, "written-jsonl")
    I.write_jsonl(products(spark, sf_dir), path)
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(F.get_json_object("value", "$.product_id")).alias("ids"))


@query("scan_raw_jsonl_tolerant", _EXTRACTED_SQL)
def scan_raw_jsonl_tolerant(spark, sf_dir):
    path = new_path(spark, "raw-jsonl")
    raw_documents(spark, sf_dir).write.options(**TEXT_FILES).text(path)
    return I.scan_raw_jsonl(spark, path).select(*PRODUCT_COLUMNS)


@query("scan_raw_jsonl_first_n", f"WITH {P_CTE} SELECT count(*) // 3 AS rows_kept FROM p")
def scan_raw_jsonl_first_n(spark, sf_dir):
    path = new_path(spark, "raw-jsonl-n")
    raw_documents(spark, sf_dir).write.options(**TEXT_FILES).text(path)
    n = table(spark, sf_dir, "lineitem").count() // 3
    return I.scan_raw_jsonl(spark, path, n).agg(F.count_distinct("product_id").alias("rows_kept"))


def mixed_documents(spark, sf_dir):
    """Raw and normalized lines together; normalized ones have even n."""
    p = numbered(spark, sf_dir)
    normalized = p.where("n % 2 = 0").select(F.to_json(F.struct(*PRODUCT_COLUMNS)).alias("value"))
    raw = p.where("n % 2 = 1").select(F.to_json(F.struct(
        F.col("product_id").alias("code"), F.struct(F.col("fat").cast("string").alias("fat_100g")).alias("nutriments"),
    )).alias("value"))
    return normalized.unionByName(raw)


@query("detect_normalized_record", f"""WITH {N_CTE}
SELECT n % 2 = 0 AS is_normalized, count(*) AS documents FROM q GROUP BY 1""")
def detect_normalized_record(spark, sf_dir):
    return I.parse_lines(mixed_documents(spark, sf_dir)).groupBy("is_normalized").agg(
        F.count(F.lit(1)).alias("documents"))


@query("project_normalized_record", f"WITH {N_CTE} SELECT * EXCLUDE (n) FROM q WHERE n % 2 = 0")
def project_normalized_record(spark, sf_dir):
    docs = I.parse_lines(mixed_documents(spark, sf_dir)).where("is_normalized")
    return I.project_normalized(docs)


@query("load_product_table", PRODUCT_SQL)
def load_product_table(spark, sf_dir):
    return I.load_product_table(spark, products(spark, sf_dir), new_path(spark, "product-table"))


@query("scan_products_table", f"WITH {P_CTE} SELECT product_id, fat, sugars, lc FROM p WHERE fat > 50")
def scan_products_table(spark, sf_dir):
    path = new_path(spark, "scan-table")
    I.load_product_table(spark, products(spark, sf_dir), path)
    return I.scan_products_table(spark, path).where("fat > 50").select("product_id", "fat", "sugars", "lc")


@query("ingest_products", _EXTRACTED_SQL)
def ingest_products(spark, sf_dir):
    path = new_path(spark, "ingest-raw")
    docs = raw_documents(spark, sf_dir)
    # every line twice: the last one of each product id stays
    docs.unionByName(docs).write.options(**TEXT_FILES).text(path)
    return I.ingest_products(spark, path, new_path(spark, "ingest-table"))


@query("snapshot_source", PRODUCT_SQL)
def snapshot_source(spark, sf_dir):
    path = I.snapshot_source(products(spark, sf_dir), new_path(spark, "snapshots"), "run-1")
    return I.scan_products_table(spark, path)


@query("last_row_per_key", f"""WITH {P_CTE} SELECT * REPLACE (fat + 1000 AS fat) FROM p""")
def last_row_per_key(spark, sf_dir):
    p = products(spark, sf_dir)
    twice = p.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0))))
    changed = twice.withColumn("fat", F.when(F.col("version") == 2, F.col("fat") + 1000).otherwise(F.col("fat")))
    return I.last_row_per_key(changed, "product_id", ("version",))

