"""Rule text to typed rules, as a job over a table of snippets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.functions.text import strip

# The rule text format (header comments, a tag in quotes, one if-condition).
_NAME = r"\$([a-zA-Z_]\w*)"
_OP = r"(>=|<=|>|<|==|!=)"
_NUMBER = r"(\d+(?:\.\d+)?)"
HEADER = r"#\s*{}:\s*([a-zA-Z0-9_]+)"
TAG = r'"([a-z0-9\-]+)"\s*;'
MISSING = rf'if\s*\(\s*!defined\s+{_NAME}\s*\|\|\s*\$\1\s+eq\s+""\s*\)'
SCALED = rf"if\s*\(\s*{_NAME}\s*{_OP}\s*\(\s*{_NAME}\s*\*\s*{_NUMBER}\s*\)\s*\)"
AFFINE = rf"if\s*\(\s*{_NAME}\s*{_OP}\s*\(\s*{_NUMBER}\s*\*\s*{_NAME}\s*([+-])\s*{_NUMBER}\s*\)\s*\)"
SUM = (rf"if\s*\(\s*\(\s*{_NAME}\s*\+\s*{_NAME}\s*\)\s*{_OP}"
       rf"\s*\(\s*{_NAME}\s*([+-])\s*{_NUMBER}\s*\)\s*\)")
FIELD = rf"if\s*\(\s*{_NAME}\s*{_OP}\s*{_NAME}\s*\)"
THRESHOLD = rf"if\s*\(\s*{_NAME}\s*{_OP}\s*{_NUMBER}\s*\)"
BODY = r"(?s)if\s*\(\s*(.*?)\s*\)\s*\{"
CLAUSE = rf"^\s*\(?\s*{_NAME}\s*{_OP}\s*{_NUMBER}\s*\)?\s*$"
TRUE_FLAGS = ("yes", "true", "1", "y")
SIMPLE_TYPES = ("field_comparison", "field_threshold", "missing_field")
MEDIUM_TYPES = ("compound_threshold_and", "sum_fields_comparison")
PROCEDURAL_TYPES = ("scaled_field_comparison", "affine_field_comparison")
IR_VERSION = "1.0"


def scan_rule_files(spark: SparkSession, path: str, pattern: str = "*.pl") -> DataFrame:
    """One snippet per rule file, ordered by name; the byte order mark and empty files go; none is an error."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(
        F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("snippet_id"),
        clean_snippet(F.col("value")).alias("snippet"),
    ).where("snippet <> ''")
    if files.isEmpty():
        raise ValueError(f"no rule file in {path}")
    return files.orderBy("snippet_id")


def clean_snippet(c: Column) -> Column:
    return strip(F.regexp_replace(c, "^﻿+", ""))


def split_rule_snippets(texts: DataFrame, id_column: str = "snippet_id", text_column: str = "text") -> DataFrame:
    """Texts with several rules to one row per block; blocks are separated by an empty line."""
    return texts.select(id_column, F.posexplode(F.split(text_column, "\n\n")).alias("block", "snippet")).select(
        id_column, "block", strip(F.col("snippet")).alias("snippet")).where("snippet <> ''")


def _group(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("snippet", pattern, group), F.lit(""))


def extract_rule_header(snippets: DataFrame) -> DataFrame:
    """Name, severity, complexity, tag and the declarative flag from the header, with defaults."""
    def named(label: str) -> Column:
        return _group(HEADER.format(label), 1)

    given = F.lower(strip(named("DECLARATIVE_FRIENDLY")))
    return snippets.withColumn("tag", _group(TAG, 1)).withColumns({
        "rule_name": F.coalesce(named("RULE_NAME"), F.replace(F.col("tag"), F.lit("-"), F.lit("_"))),
        "severity": F.coalesce(named("SEVERITY"), F.lit("error")),
        "given_complexity": named("COMPLEXITY"),
        "given_declarative": F.when(given.isNotNull(), given.isin(*TRUE_FLAGS)),
    })


def default_complexity(condition_type: Column) -> Column:
    return (F.when(condition_type.isin(*SIMPLE_TYPES), "simple")
            .when(condition_type.isin(*MEDIUM_TYPES), "medium").otherwise("intricate"))


def classify(snippets: DataFrame) -> DataFrame:
    """The condition shape; the first pattern that fits wins, null when none does."""
    text = F.col("snippet")
    parts = F.split(_group(BODY, 1), "&&")
    clauses = F.forall(parts, lambda part: part.rlike(CLAUSE))
    return snippets.withColumn("condition_type", (
        F.when(text.rlike(MISSING), "missing_field")
        .when(text.rlike(SCALED), "scaled_field_comparison")
        .when(text.rlike(AFFINE), "affine_field_comparison")
        .when(text.rlike(SUM), "sum_fields_comparison")
        .when(F.contains(text, F.lit("&&")) & F.coalesce(clauses, F.lit(False)), "compound_threshold_and")
        .when(text.rlike(FIELD), "field_comparison")
        .when(text.rlike(THRESHOLD), "field_threshold")))


def rejected_snippets(classified: DataFrame) -> DataFrame:
    """Snippets that are no rule: no tag, or no known condition shape."""
    return classified.where(F.col("tag").isNull() | F.col("condition_type").isNull())


def parse_rules(snippets: DataFrame) -> DataFrame:
    """Snippets to typed rules; see rejected_snippets for the rest."""
    kind = F.col("condition_type")

    def by_type(**cases: Column) -> Column:
        out = F.lit(None)
        for name, value in cases.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    def number(pattern: str, group: int) -> Column:
        return _group(pattern, group).try_cast("double")

    def signed(pattern: str, sign: int, group: int) -> Column:
        return F.when(_group(pattern, sign) == "-", -number(pattern, group)).otherwise(number(pattern, group))

    found = classify(extract_rule_header(snippets)).where(F.col("tag").isNotNull() & kind.isNotNull())
    clause = F.transform(F.split(_group(BODY, 1), "&&"), lambda part: F.struct(
        F.regexp_extract(part, CLAUSE, 1).alias("left_operand"),
        F.regexp_extract(part, CLAUSE, 2).alias("operator"),
        F.regexp_extract(part, CLAUSE, 3).try_cast("double").alias("right_operand")))
    typed = found.withColumns({
        "left_operand": by_type(
            missing_field=_group(MISSING, 1), scaled_field_comparison=_group(SCALED, 1),
            affine_field_comparison=_group(AFFINE, 1), field_comparison=_group(FIELD, 1),
            field_threshold=_group(THRESHOLD, 1)),
        "operator": by_type(
            missing_field=F.lit("missing"), scaled_field_comparison=_group(SCALED, 2),
            affine_field_comparison=_group(AFFINE, 2), sum_fields_comparison=_group(SUM, 3),
            compound_threshold_and=F.lit("&&"), field_comparison=_group(FIELD, 2), field_threshold=_group(THRESHOLD, 2)),
        "left_operands": by_type(sum_fields_comparison=F.array(_group(SUM, 1), _group(SUM, 2))),
        "right_field": by_type(
            scaled_field_comparison=_group(SCALED, 3), affine_field_comparison=_group(AFFINE, 4),
            sum_fields_comparison=_group(SUM, 4), field_comparison=_group(FIELD, 3)),
        "threshold_text": by_type(field_threshold=_group(THRESHOLD, 3)),
        "scale_factor": by_type(scaled_field_comparison=number(SCALED, 4), affine_field_comparison=number(AFFINE, 3)),
        "offset": by_type(affine_field_comparison=signed(AFFINE, 5, 6)),
        "right_offset": by_type(sum_fields_comparison=signed(SUM, 5, 6)),
        "clauses": by_type(compound_threshold_and=clause),
        "complexity": F.coalesce("given_complexity", default_complexity(kind)),
        "declarative_friendly": F.coalesce("given_declarative", ~kind.isin(*PROCEDURAL_TYPES)),
    })

    def shift(name: str) -> Column:
        sign = F.when(F.col(name) < 0, " - ").otherwise(" + ")
        return F.concat(sign, F.abs(F.col(name)).cast("string"))

    left, op, right = F.col("left_operand"), F.col("operator"), F.col("right_field")
    tests = F.transform("clauses", lambda c: F.concat_ws(
        " ", c["left_operand"], c["operator"], c["right_operand"].cast("string")))
    condition = by_type(
        missing_field=F.concat(F.lit("missing("), left, F.lit(")")),
        scaled_field_comparison=F.concat(left, F.lit(" "), op, F.lit(" ("), right, F.lit(" * "),
                                         F.col("scale_factor").cast("string"), F.lit(")")),
        affine_field_comparison=F.concat(left, F.lit(" "), op, F.lit(" ("), F.col("scale_factor").cast("string"),
                                         F.lit(" * "), right, shift("offset"), F.lit(")")),
        sum_fields_comparison=F.concat(F.lit("("), F.array_join("left_operands", " + "), F.lit(") "), op, F.lit(" ("),
                                       right, shift("right_offset"), F.lit(")")),
        compound_threshold_and=F.array_join(tests, " && "),
        field_comparison=F.concat_ws(" ", left, op, right),
        field_threshold=F.concat_ws(" ", left, op, F.col("threshold_text")),
    )
    return typed.withColumn("condition", condition).withColumns({
        "sql_condition": by_type(
            missing_field=F.concat(left, F.lit(" IS NULL OR TRIM("), left, F.lit(") = ''")),
            compound_threshold_and=F.array_join(tests, " AND "),
            **{t: F.col("condition") for t in ("scaled_field_comparison", "affine_field_comparison",
                                               "sum_fields_comparison", "field_comparison", "field_threshold")}),
        "threshold": F.col("threshold_text").try_cast("double"),
    }).drop("given_complexity", "given_declarative", "threshold_text")


def rule_ir(rules: DataFrame) -> DataFrame:
    """Adds rule_ir, the members that belong to the shape as JSON, and rule_ir_hash over it.

    The hash is stable for this library; key order and spacing are its own.
    """
    members = F.struct(
        "clauses", "condition_type", "left_operand", "left_operands", "offset",
        F.when(F.col("condition_type").isin("missing_field", "compound_threshold_and"), F.lit(None))
        .otherwise(F.col("operator")).alias("operator"),
        "right_field", "right_offset", "rule_name", "scale_factor", "severity", "tag", "threshold",
        F.lit(IR_VERSION).alias("version"))
    return rules.withColumn("rule_ir", F.to_json(members, {"ignoreNullFields": "true"})).withColumn(
        "rule_ir_hash", F.substring(F.sha1("rule_ir"), 1, 12))
