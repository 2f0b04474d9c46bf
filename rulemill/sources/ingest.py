"""Raw product documents to the product table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemill.functions.text import NUMBER_OR_INFINITY, first_number, non_empty, parse_number, strip, to_number
from rulemill.schemas import (
    FLAG_COLUMNS, NUMBER_COLUMNS, PRODUCT_COLUMNS, PRODUCT_SCHEMA, column_type,
)
from rulemill.session import TEXT_FILES

# Keys of each nutrient in a raw document, best first.
NUTRIENT_KEYS = {
    "energy_kj": ("energy-kj_100g", "energy-kj", "energy_100g", "energy"),
    "energy_kcal": ("energy-kcal_100g", "energy-kcal", "energy-kcal_value", "energy-kcal_value_computed"),
    "energy_kj_computed": ("energy-kj_value_computed", "energy-kj_value-computed", "energy-kj_computed"),
    "fat": ("fat_100g", "fat"),
    "saturated_fat": ("saturated-fat_100g", "saturated-fat"),
    "carbohydrates": ("carbohydrates_100g", "carbohydrates"),
    "sugars": ("sugars_100g", "sugars"),
    "starch": ("starch_100g", "starch"),
    "sodium": ("sodium_100g", "sodium"),
}
SALT_KEYS = ("salt_100g", "salt")
SODIUM_PER_SALT, SODIUM_DIGITS = 0.393, 4
# Label and category texts, and the amounts per 100 g from which a symbol is required.
SYMBOL_LABELS = ("high-in-sugars", "high-in-sodium", "high-in-saturated-fat")
EXEMPT_CATEGORIES = ("en:waters", "en:unflavoured-waters")
SYMBOL_AMOUNTS = {"sugars": 15.0, "saturated_fat": 6.0, "sodium": 0.6}

_TEXT_FIELDS = (
    "code", "_id", "id", "lc", "lang", "ingredients_text", "allergens", "traces", "allergens_from_ingredients")
_TAG_FIELDS = ("allergens_tags", "labels_tags", "categories_tags")
RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _TEXT_FIELDS]
    + [T.StructField("nutriments", T.StructType([
        T.StructField(key, T.StringType())
        for key in dict.fromkeys((*sum(NUTRIENT_KEYS.values(), ()), *SALT_KEYS))]))]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in _TAG_FIELDS]
    + [T.StructField(name, T.StringType()) for name in PRODUCT_COLUMNS if name not in _TEXT_FIELDS])
_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


# ---- scalar extractions -------------------------------------------------------------------

def nutrient(nutriments: Column, keys: tuple[str, ...]) -> Column:
    """The first numeric value under any of the keys of a struct of texts."""
    return first_number(*[nutriments.getField(key) for key in keys])


def sodium_or_salt(sodium: Column, salt: Column) -> Column:
    return F.coalesce(sodium, F.round(salt * SODIUM_PER_SALT, SODIUM_DIGITS))


def extract_product_id(code: Column, alt: Column, other: Column) -> Column:
    """The first non-empty of three ids, stripped; null when nothing is left."""
    return non_empty(strip(F.coalesce(non_empty(code), non_empty(alt), non_empty(other))))


def language_code(lc: Column, lang: Column) -> Column:
    return F.coalesce(non_empty(lc), lang)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def has_text(c: Column) -> Column:
    """A value that counts as given: not null, not empty, not an empty list or object."""
    return ~F.coalesce(c, F.lit("")).isin("", "[]", "{}", "false")


def has_items(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def contains_statement(allergens: Column, traces: Column, tags: Column) -> Column:
    return has_text(allergens) | has_text(traces) | has_items(tags)


def any_tag_contains(tags: Column, needles: tuple[str, ...]) -> Column:
    joined = F.lower(F.array_join(tags, " "))
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(joined, F.lit(needle))
    return F.coalesce(out, F.lit(False))


def symbol_required(sugars: Column, saturated_fat: Column, sodium: Column) -> Column:
    given = {"sugars": sugars, "saturated_fat": saturated_fat, "sodium": sodium}
    out = F.lit(False)
    for name, amount in SYMBOL_AMOUNTS.items():
        out = out | (F.coalesce(given[name], F.lit(0.0)) >= amount)
    return out.cast("int")


# ---- whole records ------------------------------------------------------------------------

def cast_product_column(name: str, c: Column) -> Column:
    if name in NUMBER_COLUMNS or name in FLAG_COLUMNS:
        return to_number(truth_as_number(c)).try_cast(column_type(name))
    return F.coalesce(c, F.lit("None")) if name == "product_id" else c


def truth_as_number(c: Column) -> Column:
    return F.when(c == "true", "1").when(c == "false", "0").otherwise(c)


def product_texts() -> dict[str, Column]:
    """Per product column the value that the layout of a document provides; those of NUTRIENT_KEYS and salt are in _numbers."""
    ready, food = F.col("is_normalized"), F.col("nutriments")

    def pick(name: str, raw: Column) -> Column:
        return F.when(ready, F.col(name)).otherwise(raw)

    # Candidates by number, the first that spells one is taken. All go through one function over an array: as plain columns
    # their code outgrows what the virtual machine compiles.
    given = [F.array(F.when(ready, truth_as_number(F.col(name))), *[F.when(~ready, food.getField(key)) for key in keys])
             for name, keys in NUTRIENT_KEYS.items()]
    salt = F.array(*[F.when(~ready, food.getField(key)) for key in SALT_KEYS])
    numbers = F.transform(F.array(*given, salt), lambda texts: parse_number(strip(F.get(
        F.filter(texts, lambda text: text.rlike(NUMBER_OR_INFINITY)), F.lit(0)))))
    raw_flags = {
        "contains_statement_present":
            flag(contains_statement(F.col("allergens"), F.col("traces"), F.col("allergens_tags"))),
        "allergen_evidence_present": flag(has_text(F.col("allergens_from_ingredients"))),
        "fop_symbol_present": flag(any_tag_contains(F.col("labels_tags"), SYMBOL_LABELS)),
        "fop_exempt_proxy": flag(any_tag_contains(F.col("categories_tags"), EXEMPT_CATEGORIES)),
        "product_is_prepackaged_proxy": F.lit(1),
        "ingredients_text_present": F.lit(None),
        "fop_threshold_exceeded": F.lit(None),
    }
    ready_flag = {name: to_number(truth_as_number(F.col(name))).try_cast("int") for name in FLAG_COLUMNS}
    return {
        "product_id": F.when(ready, F.coalesce("product_id", F.lit("None"))).otherwise(
            extract_product_id(F.col("code"), F.col("_id"), F.col("id"))),
        "_numbers": numbers,
        "ingredients_text": pick("ingredients_text", strip(F.coalesce("ingredients_text", F.lit("")))),
        **{name: F.when(ready, ready_flag[name]).otherwise(raw) for name, raw in raw_flags.items()},
        "lc": F.col("lc"), "lang": F.col("lang"),
        "language_code": pick("language_code", language_code(F.col("lc"), F.col("lang"))),
        "is_normalized": ready,
    }


def derive_columns(rows: DataFrame) -> DataFrame:
    """The columns that the raw layout leaves to be computed from other product columns."""
    raw = ~F.col("is_normalized")
    salted = rows.withColumn(
        "sodium", F.when(raw, sodium_or_salt(F.col("sodium"), F.col("_salt"))).otherwise(F.col("sodium")))
    computed = {
        "ingredients_text_present": flag(F.col("ingredients_text") != ""),
        "allergen_evidence_present": F.greatest("contains_statement_present", "allergen_evidence_present"),
        "fop_threshold_exceeded": symbol_required(F.col("sugars"), F.col("saturated_fat"), F.col("sodium")),
    }
    return salted.withColumns({n: F.when(raw, c).otherwise(F.col(n)) for n, c in computed.items()})


def parse_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text lines to typed raw documents; blank, malformed and non-object lines vanish.

    Adds is_normalized: the line names product_id and at least one other product column. The keys
    are only listed for lines in which that name occurs at all. The document is unpacked by a
    generator, which runs once per line: later filters cannot be pushed below it and parse again.
    """
    text = strip(F.col("value"))
    known = F.array(*map(F.lit, PRODUCT_COLUMNS[1:]))
    keys = F.json_object_keys(F.col("value"))
    normalized = F.when(
        F.contains(F.col("value"), F.lit('"product_id"')),
        F.coalesce(F.array_contains(keys, "product_id") & F.arrays_overlap(keys, known), F.lit(False)),
    ).otherwise(False)
    document = F.from_json("value", RAW_SCHEMA, _JSON)
    return lines.where(text.startswith("{") & text.endswith("}")).select(
        F.inline(F.array(F.struct(document.alias("doc"), normalized.alias("is_normalized")))), *keep,
    ).select("doc.*", "is_normalized", *keep)


def project_normalized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents that already have the product columns, as text, to typed product rows."""
    return docs.select(*[cast_product_column(n, F.col(n)).alias(n) for n in PRODUCT_COLUMNS], *keep)


def extract_products(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text lines (column value) to product rows, whichever of the two layouts a line has.

    One pass: both layouts come from the same parsed document, chosen row by row. Documents in the raw
    layout without an id are dropped.
    """
    texts = parse_lines(lines, keep).select(*[c.alias(n) for n, c in product_texts().items()], *keep)
    numbers = texts.withColumns({n: F.get("_numbers", F.lit(i)) for i, n in enumerate((*NUTRIENT_KEYS, "_salt"))})
    return derive_columns(numbers.where(F.col("product_id").isNotNull())).select(*PRODUCT_COLUMNS, *keep)


ORDER = ("_path", "_block", "_line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place in file order."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))


def first_n(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order.

    Rows are counted per file block, whole blocks are kept or dropped by the running count, and only
    the block at the boundary is numbered, so no task holds n rows.
    """
    place = Window.partitionBy("_path", "_block").orderBy("_line")
    blocks = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = before.where(F.col("_before") < n)
    whole = cut.where(F.col("_before") + F.col("_rows") <= n)
    edge = cut.where(F.col("_before") + F.col("_rows") > n)
    kept = rows.join(whole.select("_path", "_block"), ["_path", "_block"], "left_semi")
    part = (
        rows.join(F.broadcast(edge.select("_path", "_block", "_before")), ["_path", "_block"])
        .withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") <= n - F.col("_before")).drop("_place", "_before"))
    return kept.unionByName(part)


def scan_raw_jsonl(spark: SparkSession, path: str, max_products: int | None = None) -> DataFrame:
    """Usable products of a raw JSON lines file, the first max_products of them in file order; none is an error."""
    found = extract_products(read_lines(spark, path), ORDER)
    if max_products is not None:
        found = first_n(found, max_products)
    if found.isEmpty():
        raise ValueError(f"no usable product in {path}")
    return found


def last_row_per_key(rows: DataFrame, key: str = "product_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last row of each key in file order, as a combinable aggregate rather than a sort per key."""
    others = [c for c in rows.columns if c != key and c not in order]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*").select(
        *[c for c in rows.columns if c not in order])


def ingest_products(
    spark: SparkSession, path: str, table_path: str, max_products: int | None = None,
) -> DataFrame:
    """Read, extract, keep the last row per product id, write the product table and return it."""
    found = scan_raw_jsonl(spark, path, max_products)
    last_row_per_key(found).write.mode("overwrite").parquet(table_path)
    return scan_products_table(spark, table_path)


def scan_products_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Normalized JSON lines with the product schema, one row per line. Only blank lines are skipped.

    A line that is not one JSON object, or has a value of another type than its column, fails the read. An empty object
    behind each line makes a second document on it show.
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    documents = F.from_json(F.concat(F.lit("["), "value", F.lit(",{}]")), T.ArrayType(PRODUCT_SCHEMA), {**_JSON, "mode": "FAILFAST"})
    one = F.when((F.size(documents) == 2) & documents[0].isNotNull(), F.slice(documents, 1, 1)).otherwise(
        F.raise_error(F.concat(F.lit("not one JSON object: "), F.substring("value", 1, 200))))
    return lines.select(F.inline(one))


def scan_products_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT_SCHEMA).parquet(path)


def load_product_table(spark: SparkSession, products: DataFrame, path: str, view: str | None = None) -> DataFrame:
    """Replace the product table with these rows, cast to its schema."""
    products.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRODUCT_SCHEMA]).write.mode(
        "overwrite").parquet(path)
    table = scan_products_table(spark, path)
    if view:
        table.createOrReplaceTempView(view)
    return table


def snapshot_source(products: DataFrame, root: str, run_id: str) -> str:
    """Freeze the table under review; a run id is used once."""
    path = f"{root.rstrip('/')}/source/{run_id}"
    products.write.parquet(path)
    return path


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line with nulls kept, in compressed files."""
    rows.write.options(ignoreNullFields="false", **TEXT_FILES).json(path)
