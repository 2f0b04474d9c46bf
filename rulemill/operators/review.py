"""Check reviewed sheets and turn their rows into decisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions.edits import has_changes, parse_manual_edit, parse_stripped_edit
from rulemill.functions.status import (
    APPROVE_WORDS, FINAL_STATUSES, STATUSES, action_of_word, derive_issue_status, fix_id_of_text, normalize_issue_status,
    normalize_user_action, state_of_words, strip_fix_id,
)
from rulemill.functions.text import is_empty_word, normalize_optional_text, strip_cell
from rulemill.operators.issues import fill


# ---- ids that issues share ------------------------------------------------------------------

_NAMES = ("issue_id", "rule_name", "product_id")
_BETWEEN = "\x1f"


def shared_ids(issues: DataFrame) -> DataFrame:
    """Issue ids that issues of different rules or products share: ids are short hashes, so among millions some meet by chance."""
    named = issues.select("issue_id", F.xxhash64("rule_name", "product_id").alias("h"))
    return named.groupBy("issue_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where(
        "issue_id IS NOT NULL AND least <> most").select("issue_id")


def tell_apart(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Issues or sheet rows with the rule and the product behind each shared id, so that it names one issue; others stay.

    A sheet without the columns for that is left as it is.
    """
    if not set(_NAMES) <= set(rows.columns):
        return rows
    text = [F.coalesce(strip_cell(F.col(c)), F.lit("")) for c in _NAMES]
    return rows.withColumn("_id", text[0]).join(shared.select(F.col("issue_id").alias("_id"), F.lit(True).alias("_shared")), "_id", "left").withColumn(
        "issue_id", F.when(F.col("_shared"), F.concat_ws(_BETWEEN, *text)).otherwise(F.col("issue_id"))).select(*rows.columns)


def given_ids(rows: DataFrame) -> DataFrame:
    """Rows told apart with the ids they were given."""
    return rows.withColumn("issue_id", F.split_part("issue_id", F.lit(_BETWEEN), F.lit(1)))


def read_rows(sheet: DataFrame) -> DataFrame:
    """Sheet rows with the reviewer's cells in their normal form, the raw cells beside them."""
    action = normalize_user_action(F.col("user_action"))
    return sheet.select(
        "row_idx", normalize_optional_text(F.col("issue_id")).alias("issue_id"),
        F.col("user_action").alias("raw_action"), F.col("issue_status").alias("raw_status"),
        action.alias("action"), normalize_issue_status(F.col("issue_status")).alias("status"),
        derive_issue_status(F.col("issue_status"), F.col("user_action")).alias("effective_status"),
        strip_fix_id(normalize_optional_text(F.col("selected_fix_id"))).alias("fix_id"),
        normalize_optional_text(F.col("manual_edit")).alias("edit"),
    )


def mark_first(rows: DataFrame) -> DataFrame:
    """Adds is_first: the first row of its issue id.

    The first row number of each id is a combinable aggregate, and it is matched back on the row number,
    which is unique: an id repeated in a third of all rows is never gathered.
    """
    firsts = rows.where("issue_id <> ''").groupBy("issue_id").agg(F.min("row_idx").alias("row_idx")).select(
        "row_idx", F.lit(True).alias("is_first"))
    return rows.join(firsts, "row_idx", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def duplicate_issue_rows(sheet: DataFrame) -> DataFrame:
    """Rows that repeat an issue id of an earlier row."""
    return mark_first(read_rows(sheet)).where("issue_id <> '' AND NOT is_first").select("row_idx", "issue_id")


def unknown_issue_ids(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    ids = read_rows(sheet).where("issue_id <> ''").select("issue_id").distinct()
    return ids.join(issues.select("issue_id"), "issue_id", "left_anti")


def _fix_ids(issues: DataFrame) -> DataFrame:
    return issues.select("issue_id", F.col("fix_candidates.fix_id").alias("fix_ids"))


def unknown_fix_ids(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """Chosen fix ids that are none of their issue's fixes."""
    chosen = read_rows(sheet).where("fix_id <> ''").select("row_idx", "issue_id", "fix_id")
    return chosen.join(_fix_ids(issues), "issue_id").where(
        ~F.array_contains("fix_ids", F.col("fix_id"))).select("row_idx", "issue_id", "fix_id")


def check_rows(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """Every row with its checks: is_first, known, and the arrays errors and warnings."""
    marked = mark_first(read_rows(sheet))
    known = _fix_ids(issues).withColumn("known", F.lit(True))
    # only first rows look for their issue, so the join key is unique on both sides
    rows = marked.withColumn("_key", F.when(F.col("is_first"), F.col("issue_id"))).join(
        known.withColumnRenamed("issue_id", "_key"), "_key", "left").drop("_key").withColumns({
            "known": F.coalesce("known", F.lit(False)),
            "edit_error": parse_manual_edit(F.col("edit"))["error"]})
    row = {"n": F.col("row_idx").cast("string"), "issue": F.translate("issue_id", _BETWEEN, " "), "fix": F.col("fix_id"),
           "action": F.coalesce("raw_action", F.lit("")), "status": F.coalesce("raw_status", F.lit("")),
           "edit": F.col("edit_error")}

    def when(test: Column, text: str) -> Column:
        return F.when(test, fill(text, **row))

    first, ok = F.col("is_first"), F.col("known")
    chosen = (F.col("fix_id") != "") | (F.col("edit") != "")
    # Messages.
    errors = F.array(
        when(F.col("issue_id") == "", "Row {n}: issue_id is required."),
        when((F.col("issue_id") != "") & ~first, "Row {n}: duplicate issue_id `{issue}`."),
        when(first & ~ok, "Row {n}: unknown issue_id `{issue}`."),
        when(ok & ~F.col("action").isin("", "approve", "reject"), "Row {n}: invalid user_action `{action}`."),
        when(ok & ~F.col("status").isin(*STATUSES), "Row {n}: invalid issue_status `{status}`."),
        when(ok & (F.col("fix_id") != "") & ~F.array_contains("fix_ids", F.col("fix_id")),
             "Row {n}: unknown selected_fix_id `{fix}` for issue `{issue}`."),
        when(ok & F.col("edit_error").isNotNull(), "Row {n}: {edit}"),
    )
    warnings = F.array(
        when(ok & (F.col("effective_status") == "approved") & ~chosen,
             "Row {n}: marked approve but has no selected_fix_id or manual_edit; it will be skipped during apply."),
        when(ok & (F.col("effective_status") == "pending_review") & chosen,
             "Row {n}: contains a fix choice or manual edit but no user_action; it will remain pending."),
    )
    return rows.withColumns({"errors": F.array_compact(errors), "warnings": F.array_compact(warnings)})


def messages(checked: DataFrame) -> DataFrame:
    """Errors and warnings as rows (level, row_idx, message)."""
    both = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("level"), m.alias("message"))),
        F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("level"), m.alias("message"))))
    return checked.select("row_idx", F.inline_outer(both)).where("level IS NOT NULL")


def validation_counts(checked: DataFrame, missing_columns: int = 0) -> DataFrame:
    """One row: is the sheet valid, and how many rows and messages of each sort."""
    ok, status = F.col("known"), F.col("effective_status")
    errors = F.coalesce(F.sum(F.size("errors")), F.lit(0)) + F.lit(1 if missing_columns else 0)
    return checked.agg(
        (errors == 0).alias("valid"),
        F.count_if("is_first").alias("review_rows"),
        F.count_if(ok & (status == "approved")).alias("approved_rows"),
        F.count_if(ok & (status == "rejected")).alias("rejected_rows"),
        F.count_if(ok & ~status.isin("approved", "rejected")).alias("pending_rows"),
        errors.alias("error_count"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warning_count"),
    )


# ---- decisions ----------------------------------------------------------------------------

def _fix_named(fix_id: Column) -> Column:
    """The fix of that id, or null. Positions, unlike a filter, stay in generated code; that of no fix is 0."""
    return F.get("fix_candidates", F.array_position("fix_candidates.fix_id", fix_id).cast("int") - 1)


_CELLS = ("issue_id", "user_action", "issue_status", "selected_fix_id", "manual_edit")


def _stripped(sheet: DataFrame) -> DataFrame:
    """The sheet with the cells that decide stripped once, null ones empty. Actions and states are in lower case."""
    cells = {c: F.coalesce(strip_cell(F.col(c)), F.lit("")) for c in _CELLS}
    return sheet.withColumns(cells | {c: F.lower(cells[c]) for c in ("user_action", "issue_status")})


def filled(sheet: DataFrame) -> DataFrame:
    """Rows with a text for a fix or an edit: those without either cast no vote and change nothing."""
    return sheet.where("selected_fix_id <> '' OR manual_edit <> ''")


def approved_rows(sheet: DataFrame) -> DataFrame:
    """Filled rows in the state approved: the only ones that patches come from, picked before any edit is parsed."""
    # The cells, and later the state, are exploded: so no test moves below and reads a cell once for each use, and the code
    # that makes the cells and the code that reads them each stay small enough to be compiled.
    cells = sheet.withColumn("_cells", F.explode_outer(F.array(F.struct(*_CELLS)))).withColumns({c: F.col(f"_cells.{c}") for c in _CELLS})
    state = state_of_words(F.col("issue_status"), F.col("user_action"))
    return _stripped(filled(cells)).withColumn("_state", F.explode_outer(F.array(state))).where("_state = 'approved'").select(*sheet.columns)


def choices(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """Sheet rows joined with their issue, the chosen fix and the parsed edit: what votes read.

    Rows of unknown issues are left out here; unknown_issue_ids and unknown_fix_ids name the offenders.
    """
    notes = [normalize_optional_text(F.col(c)).alias(c) for c in ("review_notes", "reviewer_name", "reviewed_at_utc")]
    rows = _stripped(sheet).select(
        "row_idx", "issue_id", action_of_word(F.col("user_action")).alias("user_action"),
        state_of_words(F.col("issue_status"), F.col("user_action")).alias("issue_status"),
        fix_id_of_text(F.col("selected_fix_id")).alias("selected_fix_id"),
        parse_stripped_edit(F.col("manual_edit"))["changes"].alias("manual_changes"), *notes,
    ).where("issue_id <> ''")
    joined = rows.join(issues.select("issue_id", "product_id", "rule_name", "fix_candidates"), "issue_id")
    return joined.withColumn("selected_fix", _fix_named(F.col("selected_fix_id")))


def vote_choices(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """What the votes of a row follow from: rule_name, approved, edited, the chosen strategy or null, and those of its rivals.

    Counting these before they become votes needs neither the values of edits nor the other members of fixes.
    """
    rows = _stripped(filled(sheet)).select(
        "issue_id", F.col("user_action").isin(*APPROVE_WORDS).alias("approved"),
        has_changes(F.col("manual_edit")).alias("edited"), fix_id_of_text(F.col("selected_fix_id")).alias("fix_id"),
    ).where("issue_id <> ''")
    offered = issues.select("issue_id", "rule_name", F.col("fix_candidates.fix_id").alias("ids"),
                            F.col("fix_candidates.fix_strategy").alias("strategies"))
    joined = rows.join(offered, "issue_id").withColumn(
        "chosen", F.get("strategies", F.array_position("ids", F.col("fix_id")).cast("int") - 1))
    # ids that are unique need no look at each fix
    unique = F.size(F.array_except("ids", F.array(F.lit(None).cast("string")))) == F.size("ids")
    each = F.filter(F.arrays_zip("ids", "strategies"), lambda f: (
        f["ids"] != F.col("fix_id")) & (f["strategies"] != F.col("chosen")))["strategies"]
    rivals = F.when(F.col("approved") & F.col("chosen").isNotNull(), F.when(
        unique, F.array_remove("strategies", F.col("chosen"))).otherwise(each))
    return joined.select("rule_name", "approved", "edited", "chosen", rivals.alias("rivals"))


def decisions(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """Choices with the changes to make."""
    joined = choices(sheet, issues)
    edited = F.col("manual_changes.field")

    def change(field: Column, value: Column, source: Column, kind: str) -> Column:
        return F.struct(field.alias("field"), value.alias("new_value"), source.alias("source_fix_id"),
                        F.lit(kind).alias("source_kind"))

    fix = F.col("selected_fix")
    suggested = F.when(
        fix.isNotNull() & (fix["target_field"] != "") & ~F.array_contains(edited, fix["target_field"]),
        F.array(change(fix["target_field"], fix["new_value"], F.col("selected_fix_id"), "suggested_fix")))
    manual = F.transform("manual_changes", lambda c: change(c["field"], c["value"], F.lit("manual_edit"), "manual_edit"))
    sources = F.array_compact(F.array(
        F.when(fix.isNotNull(), F.col("selected_fix_id")),
        F.when(F.size("manual_changes") > 0, "manual_edit")))
    return joined.withColumns({
        "applied_changes": F.coalesce(F.concat(suggested, manual), manual), "source_fix_ids": sources})


def patch_preview(sheet: DataFrame, issues: DataFrame) -> DataFrame:
    """Changes of approved rows that are not applied yet: old and new value per field; a bad edit is one row."""
    text = F.col("selected_fix_id")
    state = state_of_words(F.col("issue_status"), F.col("user_action"))
    approved = _stripped(filled(sheet)).select(
        "issue_id", F.when(is_empty_word(text), F.lit("")).otherwise(text).alias("fix_id"), "manual_edit",
        # exploded, so that its test does not move below and read each cell once for each use
        F.explode_outer(F.array(state)).alias("state"),
    ).where("state = 'approved'").select(
        "issue_id", "fix_id", parse_stripped_edit(F.col("manual_edit")).alias("edit"))
    # members apart are smaller rows to shuffle and sort
    members = {"ids": "fix_id", "fields": "target_field", "values": "new_value.value", "strategies": "fix_strategy"}
    offered = issues.select("issue_id", "product_id", "rule_name", "current_values", *[
        F.col(f"fix_candidates.{member}").alias(name) for name, member in members.items()])
    rows = approved.join(offered, "issue_id").withColumn("at", F.array_position("ids", F.col("fix_id")).cast("int") - 1)

    def line(source, field, value, strategy) -> Column:
        return F.struct(source.alias("source"), field.alias("field"), value.alias("new_value"), strategy.alias("fix_strategy"))

    blank = F.lit("")
    suggested = F.when(
        F.get("fields", F.col("at")) != "", F.array(line(
            F.lit("suggested_fix"), *[F.get(name, F.col("at")) for name in ("fields", "values", "strategies")])))
    manual = F.transform(F.col("edit.changes"), lambda c: line(
        F.lit("manual_edit"), c["field"], c["value"]["value"], F.lit("manual_edit")))
    bad = F.array(line(F.lit("invalid_manual_edit"), blank, blank, F.col("edit.error")))
    lines = F.when(F.col("edit.error").isNotNull(), bad).otherwise(F.coalesce(F.concat(suggested, manual), manual))
    # put together before they are taken apart, as only then in generated code; the old value is found after that, so that
    # whoever does not read it needs no current values
    old = F.when(F.col("source") == "invalid_manual_edit", blank).otherwise(F.try_element_at("current_values", F.col("field")))
    return rows.withColumn("lines", lines).select(
        "issue_id", "product_id", "rule_name", "current_values", F.inline_outer("lines")).where("source IS NOT NULL").select(
        "issue_id", "product_id", "rule_name", "source", "field", old.alias("old_value"), "new_value", "fix_strategy")


# ---- states -------------------------------------------------------------------------------

def status_updates_applied(decided: DataFrame) -> DataFrame:
    """Every approved issue becomes applied, whether or not it changed a value."""
    return decided.where("issue_status = 'approved'").select("issue_id", F.lit("applied").alias("new_status")).distinct()


def status_update_join(sheet: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrites the status of the rows whose issue id is in the updates."""
    return sheet.join(updates, "issue_id", "left").withColumn(
        "issue_status", F.coalesce("new_status", "issue_status")).select(*sheet.columns)


def revalidated_updates(sheet: DataFrame, after_issues: DataFrame) -> DataFrame:
    """New states of applied rows: remaining while the issue still exists, otherwise resolved."""
    applied = sheet.where(F.col("issue_status").isin(*FINAL_STATUSES)).select("issue_id").distinct()
    still = after_issues.select("issue_id", F.lit(True).alias("still")).distinct()
    return applied.join(still, "issue_id", "left").select("issue_id", F.when(
        F.col("still"), "revalidated_remaining").otherwise("revalidated_resolved").alias("new_status"))


def status_counts(sheet: DataFrame) -> DataFrame:
    """Rows per derived state, zeros included."""
    status = derive_issue_status(F.col("issue_status"), F.col("user_action"))
    counts = sheet.select(status.alias("s")).agg(*[F.count_if(F.col("s") == s).alias(s) for s in STATUSES])
    pairs = ", ".join(f"'{s}', {s}" for s in STATUSES)
    return counts.selectExpr(f"stack({len(STATUSES)}, {pairs}) AS (issue_status, row_count)")


def review_progress(sheet: DataFrame, patches: DataFrame) -> DataFrame:
    status = derive_issue_status(F.col("issue_status"), F.col("user_action"))
    rows = sheet.select(status.alias("s")).agg(
        F.count(F.lit(1)).alias("reviewed_rows"),
        *[F.count_if(F.col("s") == s).alias(f"{name}_rows") for name, s in (
            ("approved", "approved"), ("rejected", "rejected"), ("applied", "applied"),
            ("resolved", "revalidated_resolved"))])
    changed = patches.agg(F.count_distinct("product_id").alias("changed_products"))
    one = F.lit(1).alias("_one")
    return rows.select("*", one).join(F.broadcast(changed.select("*", one)), "_one").drop("_one")
