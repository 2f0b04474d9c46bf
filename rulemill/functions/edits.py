"""Manual edits: field=value pairs or a JSON object, as typed changes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulemill.functions.text import SPACES_SQL, bound, double_text, is_empty_word, normalize_optional_text, strip
from rulemill.functions.values import coerce_edit_value, typed

CHANGES = "array<struct<field:string,value:struct<kind:string,value:string>>>"
# A chunk between semicolons that is not blank and has no mark.
BAD_CHUNK = rf"(?:\A|;)[{SPACES_SQL}]*+[^;=:{SPACES_SQL}][^;=:]*+(?:;|\z)"


def _json_value(v: Column) -> Column:
    """A JSON value as (kind, value); nested values stay JSON text."""
    text = v.cast("string")

    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "VOID", typed(F.lit("null"), F.lit(None).cast("string")))
            .when(kind == "BOOLEAN", typed(F.lit("int"), F.when(text == "true", "1").otherwise("0")))
            .when(kind == "BIGINT", typed(F.lit("int"), text))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
                  typed(F.lit("double"), bound(v.try_cast("double"), double_text)))
            .otherwise(typed(F.lit("string"), text)))

    return bound(F.schema_of_variant(v), by_kind)


def _last_of_each(changes: Column) -> Column:
    """Later changes of a field replace earlier ones."""
    def last(made: Column) -> Column:
        names = made["field"]
        return F.when(F.size(F.array_distinct(names)) == F.size(names), made).otherwise(
            F.filter(made, lambda c, i: ~F.array_contains(
                F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), c["field"])))

    return bound(changes, last)


def parse_manual_edit(c: Column) -> Column:
    """struct(changes, error): no changes for an empty cell; an error text, and no changes, for a bad one."""
    text = normalize_optional_text(c)
    return _parsed(text, text == "")


def parse_stripped_edit(text: Column) -> Column:
    """parse_manual_edit of a stripped cell."""
    return _parsed(text, is_empty_word(text))


def has_changes(text: Column) -> Column:
    """Whether parse_manual_edit finds changes in a stripped cell; it stays in generated code, as no value is worked out."""
    members = F.size(F.try_parse_json(text).cast("map<string,variant>"))
    return (
        F.when(is_empty_word(text), False)
        .when(text.startswith("{"), F.coalesce(members > 0, F.lit(False)))
        .otherwise(text.rlike("[=:]") & ~text.rlike(BAD_CHUNK)))


def _parsed(text: Column, empty: Column) -> Column:
    none = F.array().cast(CHANGES)

    def result(changes: Column, error: Column) -> Column:
        return F.struct(changes.cast(CHANGES).alias("changes"), error.cast("string").alias("error"))

    def of_object(parsed: Column) -> Column:
        changes = F.transform(
            F.map_entries(parsed.cast("map<string,variant>")),
            lambda e: F.struct(e["key"].alias("field"), _json_value(e["value"]).alias("value")))
        return F.when(parsed.isNull(), result(none, F.lit("manual_edit is not a JSON object of field/value pairs."))).otherwise(
            result(changes, F.lit(None)))

    def pair(chunk: Column) -> Column:
        mark = F.when(F.contains(chunk, F.lit("=")), "=").otherwise(":")
        return bound(F.position(mark, chunk), lambda at: F.struct(
            strip(F.substring(chunk, F.lit(1), at - 1)).alias("field"),
            coerce_edit_value(F.substring(chunk, at + 1, F.length(chunk))).alias("value")))

    def of_chunks(chunks: Column) -> Column:
        bad = F.get(F.filter(chunks, lambda x: ~x.rlike("[=:]")), F.lit(0))
        return bound(bad, lambda first: F.when(first.isNotNull(), result(none, F.concat(
            F.lit("Invalid manual_edit chunk `"), first, F.lit("`. Use field=value pairs.")))).otherwise(
                result(_last_of_each(F.transform(chunks, pair)), F.lit(None))))

    def of_text(text: Column) -> Column:
        return (
            F.when(text.startswith("{"), bound(F.try_parse_json(text), of_object))
            .otherwise(bound(F.filter(F.transform(F.split(text, ";"), strip), lambda x: x != ""), of_chunks)))

    # most cells are empty and need no function
    return F.when(empty, result(none, F.lit(None))).otherwise(bound(text, of_text))
