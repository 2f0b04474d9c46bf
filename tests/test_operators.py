"""Small hand-made cases: nulls, white space, ties, repeats and invariants."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.functions import text as X
from rulemill.functions.edits import parse_manual_edit
from rulemill.functions.hashing import issue_id, patch_id
from rulemill.functions.stats import beta_quantile, wilson_bounds
from rulemill.functions.values import coerce_edit_value, double_text, typed
from rulemill.operators import apply as A
from rulemill.operators import evaluate as E
from rulemill.operators import feedback as B
from rulemill.operators import parity as P
from rulemill.operators import ranking
from rulemill.operators import verify as V
from rulemill.rules import catalog as K
from rulemill.rules.packs import select_rules, validate_profile
from rulemill.rules.spec import SHIPPED, SHIPPED_BY_NAME, mutants, rules_frame
from rulemill.schemas import PRODUCT_SCHEMA
from rulemill.sources import ingest as I

BASE = E.Pack("baseline")


def product(product_id, **values):
    row = {f.name: None for f in PRODUCT_SCHEMA}
    row.update(product_id=product_id, lc="en", lang="en", language_code="en")
    row.update(values)
    return tuple(row[f.name] for f in PRODUCT_SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PRODUCT_SCHEMA)


def tags(spark, *rows):
    return {r.product_id: r.tags for r in E.product_tags(frame(spark, *rows), BASE).collect()}


@pytest.mark.parametrize("rule, bad, good", [
    ("energy_kcal_vs_kj", {"energy_kcal": 200.0, "energy_kj": 100.0}, {"energy_kcal": 50.0, "energy_kj": 100.0}),
    ("sugars_over_105g", {"sugars": 106.0}, {"sugars": 104.9}),
    ("energy_kj_mismatch_low", {"energy_kj": 300.0, "energy_kcal": 100.0}, {"energy_kj": 380.0, "energy_kcal": 100.0}),
    ("energy_kj_mismatch_high", {"energy_kj": 500.0, "energy_kcal": 100.0}, {"energy_kj": 450.0, "energy_kcal": 100.0}),
    ("energy_kj_computed_mismatch_low", {"energy_kj_computed": 60.0, "energy_kj": 100.0},
     {"energy_kj_computed": 80.0, "energy_kj": 100.0}),
    ("sugars_plus_starch_vs_carbohydrates", {"sugars": 12.0, "starch": 8.2, "carbohydrates": 20.0},
     {"sugars": 8.0, "starch": 6.0, "carbohydrates": 20.0}),
    ("main_language_code_missing", {"lc": " \t "}, {"lc": "en"}),
])
def test_rule_points(spark, rule, bad, good):
    tag = SHIPPED_BY_NAME[rule].tag
    found = tags(spark, product("bad", **bad), product("good", **good), product("nulls"))
    assert tag in found["bad"] and tag not in found["good"] and found["nulls"] == []


def test_blank_differs_between_sources(spark):
    p = frame(spark, product("tab", lc="\t"), product("spaces", lc="  "))
    flags = P.verdict_flags(E.rule_verdicts(p, BASE), E.rule_verdicts(p, E.sql_pack("sql")))
    assert [(r.rule_name, r.product_id) for r in P.mismatches(flags).collect()] == [("main_language_code_missing", "tab")]
    one = {r.rule_name: r for r in P.counts_by_source(p, BASE, [E.sql_pack("sql")]).collect()}
    two = {r.rule_name: r for r in P.count_flags(flags, p, rules_frame(spark, SHIPPED)).collect()}
    assert len(one) == len(two) == 19
    for name, row in one.items():
        assert row.matches + row.mismatches == row.products_tested == 2
        assert row.positive_matches <= row.supporting_violations
        assert all(row[c] == two[name][c] for c in (*P.COUNTS, "matches", "products_tested"))


def test_no_products(spark):
    rows = P.add_wilson(P.add_rates(P.counts_by_source(frame(spark), BASE, [E.sql_pack("sql")]))).collect()
    assert len(rows) == 19
    assert all(r.confidence == 1.0 and (r.parity_ci_lower, r.parity_ci_upper) == (0.0, 1.0) for r in rows)


def test_several_packs_in_one_scan(spark):
    p = frame(spark, product("a", fat=110.0), product("b", lc=""))
    rows = {tuple(r) for r in E.rule_verdicts(p, BASE, E.sql_pack("sql")).collect()}
    assert rows == {(s, r, i) for s in ("baseline", "sql") for r, i in (
        ("fat_over_105g", "a"), ("main_language_code_missing", "b"))}


def test_intervals(spark):
    low, high = wilson_bounds(F.lit(80), F.lit(80))
    row = spark.range(1).select(low.alias("l"), high.alias("h")).head()
    assert row.l == pytest.approx(80 / (80 + 1.96 ** 2)) and row.h == 1.0
    assert beta_quantile(0.05, np.array([11.0]), np.array([1.0]))[0] == pytest.approx(0.05 ** (1 / 11))
    big = beta_quantile(0.05, np.array([5e8]), np.array([5e8]))[0]
    assert big == pytest.approx(0.5 - 1.6448536 * math.sqrt(0.25 / 1e9), abs=1e-9)


def values(spark, cells, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    cells = ["12", " 1.5 ", "1_000", "12d", "1__0", "NaN", "-inf", "", None, ".5", "5.", "1e3", "true", "0x10"]
    want = [12.0, 1.5, 1000.0, None, None, None, -math.inf, None, None, 0.5, 5.0, 1000.0, None, None]
    assert values(spark, cells, X.to_number) == want


def test_double_text(spark):
    numbers = [334.85, 105.0, 1e7, 123456789.25, 1e16, 1.5e-7, 0.0005, -2.0, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r.v for r in df.select("i", double_text(F.col("x")).alias("v")).orderBy("i").collect()] == [
        repr(x) for x in numbers]


def test_edits(spark):
    cells = ["carbohydrates=103;sugars=100", '{"fat": 10, "x": true, "y": null, "z": 1.5}', "nan", "", "broken", "{bad", "a=1;a=2",
             "t: a=b"]
    out = values(spark, cells, parse_manual_edit)
    changes = [[(c.field, c.value.kind, c.value.value) for c in o.changes] for o in out]
    assert changes[0] == [("carbohydrates", "int", "103"), ("sugars", "int", "100")]
    assert sorted(changes[1]) == [("fat", "int", "10"), ("x", "int", "1"), ("y", "null", None), ("z", "double", "1.5")]
    assert changes[2:6] == [[], [], [], []] and [o.error is not None for o in out] == [False] * 4 + [True, True, False, False]
    assert changes[6] == [("a", "int", "2")] and changes[7] == [("t: a", "string", "b")]
    assert [tuple(v) for v in values(spark, ["blank", "YES", "07", "1.0"], coerce_edit_value)] == [
        ("null", None), ("int", "1"), ("int", "7"), ("double", "1.0")]


def test_ids(spark):
    value = typed(F.lit("double"), F.lit("334.85"))
    row = spark.range(1).select(
        issue_id(F.lit("energy_kcal_vs_kj"), F.lit("0000000000001")).alias("i"),
        patch_id(F.lit("612aa227477e"), F.lit("0000000000001"), F.lit("energy_kcal"), value).alias("p")).head()
    assert (row.i, row.p) == ("612aa227477e", "6e0f0f4d6f175d")


def test_patch_chain_order_and_no_ops(spark):
    p = frame(spark, product("p1", fat=120.0, lc=None), product("p2", fat=1.0))
    rows = [(1, "p1", "fat", ("double", "105.0")), (2, "p1", "fat", ("int", "105")), (3, "p1", "fat", ("null", None)),
            (4, "p1", "lc", ("null", None)), (5, "p1", "lc", ("string", "fr")), (6, "gone", "fat", ("int", "1")),
            (7, "p1", "made_up", ("int", "1"))]
    changes = spark.createDataFrame(
        [(i, f"i{i}", pid, "r", "", "", "", f, v, "fix", "suggested_fix") for i, pid, f, v in rows],
        "row_idx long, issue_id string, product_id string, rule_name string, review_notes string, reviewer_name string,"
        " reviewed_at_utc string, field string, new_value struct<kind:string,value:string>, source_fix_id string,"
        " source_kind string")
    patches = A.patch_chain(changes, p)
    got = {r.row_idx: (r.old_value.value, r.new_value.value) for r in patches.collect()}
    assert got == {1: ("120.0", "105.0"), 3: ("105", None), 5: (None, "fr"), 7: (None, "1")}
    fixed = {r.product_id: r for r in A.apply_patches(p, patches, small=True).collect()}
    assert fixed["p1"].fat is None and fixed["p1"].lc == "fr" and fixed["p2"].fat == 1.0 and len(fixed) == 2
    assert A.apply_patches(frame(spark, *[tuple(r) for r in fixed.values()]), patches).count() == 2


def test_first_n_is_the_same_with_and_without_salt(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"), "id")
    for n in (7, ranking.GROUP_LIMIT + 500):
        got = ranking.first_n_per_key(df, ["k"], [F.col("id")], n, ["id"])
        rows = {k: sorted(r.id for r in got.where(F.col("k") == k).collect()) for k in ("hot", "cold")}
        assert rows["hot"] == list(range(0, 5000, 3))[:n]
        assert rows["cold"] == [i for i in range(5000) if i % 3][:n]


def test_first_lines_in_file_order(spark, tmp_path):
    lines = "\n".join('{"product_id": "%04d", "fat": %d}' % (i, i) for i in range(100))
    (tmp_path / "raw.jsonl").write_text(lines)
    got = I.scan_raw_jsonl(spark, str(tmp_path / "raw.jsonl"), 37)
    assert sorted(r.product_id for r in got.collect()) == ["%04d" % i for i in range(37)]
    (tmp_path / "none.jsonl").write_text("\n[1]\n{}\n")
    with pytest.raises(ValueError):
        I.scan_raw_jsonl(spark, str(tmp_path / "none.jsonl"))


def test_raw_layout(spark):
    lines = spark.createDataFrame([(x,) for x in (
        '{"code": "", "_id": " 7 ", "nutriments": {"fat": "3,5", "fat_100g": true, "salt": 2}, "labels_tags": "high-in-sugars"}',
        '{"code": "8", "nutriments": "none", "lc": "", "lang": "fr", "ingredients_text": " x "}',
        '{"product_id": "9", "fat": "1e1", "fop_symbol_present": true}', '{"product_id": "10"}', "{'code': 'x'}",
    )], "value string")
    rows = {r.product_id: r for r in I.extract_products(lines).collect()}
    assert set(rows) == {"7", "8", "9"}
    assert rows["7"].fat is None and rows["7"].sodium == 0.786 and rows["7"].fop_symbol_present == 0
    assert rows["7"].fop_threshold_exceeded == 1
    assert rows["8"].language_code == "fr" and rows["8"].ingredients_text_present == 1 and rows["8"].energy_kj is None
    assert rows["9"].fat == 10.0 and rows["9"].fop_symbol_present == 1 and rows["9"].ingredients_text_present is None


def test_catalog_gives_the_shipped_rules_back(spark):
    def source(r):
        if r.condition_type == "missing_field":
            body = f'!defined ${r.left[0]} || ${r.left[0]} eq ""'
        elif r.clauses:
            body = " && ".join(f"(${n} {o} {x:g})" for n, o, x in r.clauses)
        else:
            body = r.condition
            for name in r.fields:
                body = " ".join(
                    word.replace(name, f"${name}") if word.strip("()") == name else word for word in body.split(" "))
        head = f"# RULE_NAME: {r.rule_name}\n# SEVERITY: {r.severity}\n# COMPLEXITY: {r.complexity}\n"
        return f'{head}# DECLARATIVE_FRIENDLY: {"yes" if r.declarative_friendly else "no"}\nif ({body}) {{\n  add "{r.tag}";\n}}'

    texts = spark.createDataFrame([(r.rule_name, source(r)) for r in SHIPPED], "snippet_id string, snippet string")
    assert K.rejected_snippets(K.classify(K.extract_rule_header(texts))).count() == 0
    columns = ["rule_name", "tag", "severity", "complexity", "declarative_friendly", "condition_type", "operator",
               "left_operand", "left_operands", "right_field", "threshold", "scale_factor", "offset", "right_offset", "clauses"]
    parsed = {r.rule_name: r for r in K.parse_rules(texts).select(*columns).collect()}
    for row in rules_frame(spark, SHIPPED).select(*columns).collect():
        assert parsed[row.rule_name] == row


def test_profiles():
    assert len(select_rules(SHIPPED, "canada")) == 7 and len(select_rules(SHIPPED, "global")) == 12
    with pytest.raises(ValueError):
        validate_profile("mars")


def test_cases_and_mutants(spark):
    cases = V.boundary_cases(V.default_draws(spark, SHIPPED), SHIPPED)
    assert V.failing_cases(cases, BASE).count() == 0
    assert all(r.equivalence_status == "PASS" for r in V.equivalence(cases, BASE, BASE).collect())
    scores = {r.rule_name: r for r in V.mutation_score(V.mutant_kills(cases, SHIPPED), rules_frame(spark, SHIPPED)).collect()}
    assert scores["main_language_missing"].mutation_score == 1.0
    assert scores["ca_fop_required_but_symbol_missing"].mutation_total == 0
    assert all(r.mutation_total == len(mutants(SHIPPED_BY_NAME[n])) for n, r in scores.items())


def test_same_feedback_batch_counts_once(spark):
    votes = spark.createDataFrame([("r", "s", 1, 0), ("r", "t", 0, 1)], "rule_name string, fix_strategy string, accepted long, rejected long")
    empty = spark.createDataFrame([], "batch_id string, rule_name string, fix_strategy string, accepted long, rejected long")
    once = B.feedback_merge(empty, votes, "b1")
    assert B.feedback_merge(once, votes, "b1").count() == 2 and B.feedback_merge(once, votes, "b2").count() == 4


def test_tags_run_on_a_stream(spark, tmp_path):
    frame(spark, product("a", fat=110.0)).write.parquet(str(tmp_path / "in"))
    stream = E.product_tags(spark.readStream.schema(PRODUCT_SCHEMA).parquet(str(tmp_path / "in")), BASE)
    query = stream.writeStream.format("memory").queryName("tagged").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("tagged").head().tags == ["fat-value-over-105g"]
