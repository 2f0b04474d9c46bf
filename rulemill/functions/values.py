"""Values of mixed type as a (kind, value) struct."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulemill.functions.text import INTEGER_PATTERN, NUMBER_PATTERN, bound, double_text, strip
from rulemill.schemas import FLAG_COLUMNS, NUMBER_COLUMNS

# Words a reviewer may write instead of a value.
NULL_WORDS = ("null", "none", "blank")
TRUE_WORDS = ("true", "yes")
FALSE_WORDS = ("false", "no")


def typed(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), value.cast("string").alias("value"))


def null_value() -> Column:
    return typed(F.lit("null"), F.lit(None).cast("string"))


def column_value(field: str, columns: dict[str, str]) -> Column:
    """The value of the product column that the SQL reference field names, with the kind of its type.

    columns maps the names to SQL references; numbers are chosen first and printed once.
    """
    def choose(names) -> Column:
        cases = " ".join(f"WHEN '{n}' THEN {columns[n]}" for n in columns if n in names)
        return F.expr(f"CASE {field} {cases} END")

    number, flag = double_text(choose(NUMBER_COLUMNS)), choose(FLAG_COLUMNS).cast("string")
    text = choose([n for n in columns if n not in NUMBER_COLUMNS and n not in FLAG_COLUMNS])
    kind = (F.when(number.isNotNull(), "double").when(flag.isNotNull(), "int").when(text.isNotNull(), "string")
            .otherwise("null"))
    return typed(kind, F.coalesce(number, flag, text))


def whole_number_text(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("_"), F.lit("")), r"^[+-]", ""), r"^0+(?=\d)", "")
    return F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def coerce_edit_value(raw: Column) -> Column:
    """A reviewer's text to a typed value: null words, yes and no, numbers, otherwise text."""
    return bound(strip(raw), lambda text: bound(F.lower(text), lambda word: _coerced(text, word)))


def _coerced(text: Column, word: Column) -> Column:
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    is_double = text.contains(".") & text.rlike(NUMBER_PATTERN)
    is_int = ~text.contains(".") & text.rlike(INTEGER_PATTERN)
    kind = (
        F.when(word.isin(*NULL_WORDS), "null")
        .when(word.isin(*TRUE_WORDS, *FALSE_WORDS) | is_int, "int")
        .when(is_double, "double")
        .otherwise("string")
    )
    value = (
        F.when(word.isin(*NULL_WORDS), F.lit(None).cast("string"))
        .when(word.isin(*TRUE_WORDS), "1")
        .when(word.isin(*FALSE_WORDS), "0")
        .when(is_int, whole_number_text(text))
        .when(is_double, bound(number, double_text))
        .otherwise(text)
    )
    return typed(kind, value)


def is_numeric(v: Column) -> Column:
    return v["kind"].isin("int", "double")


def same_value(a: Column, b: Column) -> Column:
    """Equal values: numbers by size whatever their kind, text by content, null with null."""
    return (
        F.when(is_numeric(a) & is_numeric(b), a["value"].try_cast("double") == b["value"].try_cast("double"))
        .otherwise((a["kind"] == b["kind"]) & a["value"].eqNullSafe(b["value"]))
    )


def json_text(v: Column) -> Column:
    """The value as JSON text."""
    quoted = F.to_json(F.array(v["value"]), {"writeNonAsciiCharacterAsCodePoint": "true"})
    return (
        F.when(v["kind"] == "null", "null")
        .when(v["kind"] == "string", F.substring(quoted, F.lit(2), F.length(quoted) - 2))
        .otherwise(v["value"])
    )


def as_column(v: Column, name: str) -> Column:
    """A typed value as the type of a product column; text that is no number gives null."""
    if name in NUMBER_COLUMNS:
        return F.when(is_numeric(v), v["value"].try_cast("double")).when(
            v["value"].rlike(NUMBER_PATTERN), v["value"].try_cast("double"))
    if name in FLAG_COLUMNS:
        return F.when(is_numeric(v) | v["value"].rlike(NUMBER_PATTERN), v["value"].try_cast("double").try_cast("int"))
    return v["value"]
