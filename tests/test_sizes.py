"""What steps write and how often they work a value out."""
from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from rulemill.functions.edits import parse_manual_edit
from rulemill.operators import apply as A
from rulemill.operators import fixes as X
from rulemill.registry import all_queries  # noqa: F401  (fills QUERIES)
from rulemill.registry import QUERIES
from rulemill.registry.issue_queries import issue_rules
from rulemill.operators import issues as I
from rulemill.operators.evaluate import Pack
from rulemill.schemas import PRODUCT_SCHEMA
from rulemill.sources import ingest
from rulemill.sources import sheets
from rulemill.session import shared_dir


def _size(path: str) -> int:
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))


def _products(spark, n: int):
    rows = spark.range(n).withColumn("product_id", F.concat(F.lit("p"), "id"))
    return rows.select(*[
        F.col(f.name) if f.name == "product_id" else F.lit({"double": "120", "integer": "1"}.get(f.dataType.typeName(), "")).cast(
            f.dataType).alias(f.name) for f in PRODUCT_SCHEMA])


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_lines_are_compressed_and_read_back(spark, tmp_path):
    rows = _products(spark, 2000)
    ingest.write_jsonl(rows, str(tmp_path / "p"))
    plain = spark.read.text(str(tmp_path / "p")).agg(F.sum(F.length("value"))).first()[0]
    assert _size(tmp_path / "p") < plain / 4
    back = ingest.scan_products_jsonl(spark, str(tmp_path / "p"))
    assert back.exceptAll(rows).isEmpty() and back.count() == 2000


def test_sheets_are_compressed_and_read_back(spark, tmp_path):
    found = X.rank_fixes(X.with_fixes(I.issues_join(_products(spark, 500), Pack("baseline"), issue_rules(spark))))
    sheet = X.review_sheet(found)
    sheets.write_review_sheet(sheet, str(tmp_path / "s"))
    plain = spark.read.text(str(tmp_path / "s")).agg(F.sum(F.length("value"))).first()[0]
    assert _size(tmp_path / "s") < plain / 4
    back = sheets.scan_review_sheet(spark, str(tmp_path / "s")).drop("row_idx")
    assert back.count() == sheet.count() and back.exceptAll(sheet).isEmpty()


def test_fixes_with_fewer_members_are_the_same_fixes(spark):
    found = I.issues_join(_products(spark, 50), Pack("baseline"), issue_rules(spark))
    whole = X.rank_fixes(X.with_fixes(found)).select("issue_id", F.inline("fix_candidates")).select("issue_id", *X.DECIDING_MEMBERS)
    few = X.rank_fixes(X.with_fixes(found, X.DECIDING_MEMBERS), X.DECIDING_MEMBERS).select("issue_id", F.inline("fix_candidates"))
    assert few.columns == whole.columns
    assert few.count() == whole.count() and few.exceptAll(whole).isEmpty()


def test_an_edit_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([('{"fat": 10, "lang": null}',), ("a=1;b=2;a=x",), ("{broken",), ("fat",), (None,)], "t string").write.parquet(
        str(tmp_path / "e"))
    rows = spark.read.parquet(str(tmp_path / "e")).select("t", parse_manual_edit(F.col("t")).alias("e"))
    assert rows._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    got = {r.t: ([(c.field, c["value"].kind, c["value"].value) for c in r.e.changes], r.e.error is not None) for r in rows.collect()}
    assert got == {
        '{"fat": 10, "lang": null}': ([("fat", "int", "10"), ("lang", "null", None)], False),
        "a=1;b=2;a=x": ([("b", "int", "2"), ("a", "string", "x")], False),
        "{broken": ([], True), "fat": ([], True), None: ([], False)}


def test_changes_meet_the_products_in_one_join(spark):
    value = F.struct(F.lit("double").alias("kind"), F.lit("105.0").alias("value"))
    changes = spark.range(20).select(
        (F.col("id") + 2).alias("row_idx"), F.concat(F.lit("i"), "id").alias("issue_id"), F.concat(F.lit("p"), "id").alias("product_id"),
        F.lit("fat_over_105g").alias("rule_name"), *[F.lit("").alias(n) for n in A.NOTES], F.lit("fat").alias("field"),
        value.alias("new_value"), F.lit("f").alias("source_fix_id"), F.lit("suggested_fix").alias("source_kind"))
    products = _products(spark, 10)
    whole, small = (A.patch_chain(changes, products, small=s) for s in (False, True))
    assert _plan(whole).count("Join") == 1
    assert whole.count() == 10 and whole.exceptAll(small).isEmpty()


def test_rule_files_are_far_fewer_than_rules(spark, tmp_path):
    """Every rule comes back, also those whose key repeats."""
    keys = spark.range(1, 401).union(spark.range(1, 11)).select(F.col("id").cast("bigint").alias("p_partkey"))
    keys.select("p_partkey", F.lit("a part").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL TIN").alias("p_type"),
                F.lit(7).alias("p_size"), F.lit(900.5).alias("p_retailprice")).write.parquet(str(tmp_path / "part.parquet"))
    before = set(glob.glob(f"{shared_dir(spark)}/rule-files-*"))
    got = QUERIES["scan_rule_files"].run(spark, str(tmp_path)).first()
    assert (got.snippets, got.tags) == (410, 400)
    made, = set(glob.glob(f"{shared_dir(spark)}/rule-files-*")) - before
    assert len(glob.glob(f"{made}/**/part-*", recursive=True)) <= 6
