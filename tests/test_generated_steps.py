"""How the review steps are planned, and that shorter ways give the same rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions.status import derive_issue_status
from rulemill.operators import feedback as B
from rulemill.operators import fixes as X
from rulemill.operators import verify as V
from rulemill.rules.spec import SHIPPED


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_state_reads_its_words_few_times(spark, tmp_path):
    rows = [("pending", " Yes"), ("Resolved", "no"), ("bogus", "maybe"), (None, None), ("approve", ""), ("none", "SKIP ")]
    spark.createDataFrame(rows, "s string, a string").write.parquet(str(tmp_path / "s"))
    states = spark.read.parquet(str(tmp_path / "s")).select("s", "a", derive_issue_status(F.col("s"), F.col("a")).alias("d"))
    assert states._jdf.queryExecution().analyzed().toString().count("lower(") <= 3
    assert {(r.s, r.a): r.d for r in states.collect()} == dict(zip(rows, (
        "approved", "revalidated_resolved", "pending_review", "pending_review", "approved", "rejected")))


def test_only_counts_are_rolled_up(spark):
    events = spark.range(40).select(
        F.expr("if(id % 4 = 0, NULL, concat('r', id % 3))").alias("rule_name"), F.expr("concat('s', id % 2)").alias("fix_strategy"),
        F.lit(1).cast("long").alias("accepted"), (F.col("id") % 2).alias("rejected"))
    counts = B.feedback_counts(events)
    assert _plan(counts).count("Aggregate") == 2
    assert {r.fix_strategy: (r.accepted, r.rejected) for r in counts.where("scope = 'global'").collect()} == {
        "s0": (20, 0), "s1": (20, 20)}


def test_fixes_are_ranked_alike_with_fewer_members(spark):
    """Ties, missing scores and more fixes than a family has."""
    kinds = "array<struct<fix_id:string,target_field:string,confidence:double,fix_strategy:string>>"
    scores = (0.5, 0.9, None, 0.5)
    lists = [[(f"f{i}", "fat", scores[(i * step + start) % 4], "clamp_to_limit") for i in range(n)]
             for n in range(1, 6) for start in range(4) for step in (1, 3)]
    rows = spark.createDataFrame([(i, "error", "t", found) for i, found in enumerate(lists)] + [(99, "error", "t", None)],
                                 f"id int, severity string, condition_type string, fix_candidates {kinds}")
    whole = rows.select("id", F.expr("""transform(sort_array(transform(fix_candidates, (f, i) -> named_struct(
        's', -(f.confidence + 0.05D + 0.02D), 'i', i, 'f', f))), k -> k.f.fix_id)""").alias("ids"))
    ranked = X.rank_fixes(rows, ("fix_id", "target_field"))
    assert "_s" in _plan(ranked)
    few = ranked.select("id", F.col("fix_candidates.fix_id").alias("ids"))
    assert few.exceptAll(whole).isEmpty() and few.count() == len(lists) + 1


def test_draws_are_reduced_before_their_cases_are_made(spark):
    draws = V.default_draws(spark, SHIPPED)
    cases = V.boundary_cases(draws.union(draws), SHIPPED)
    assert _plan(cases).count("Aggregate") == 3
    content = [F.to_json(F.array_sort(F.map_entries("inputs"))).alias("key"), "rule_name"]
    plain = V.distinct_cases(V.case_table(draws, SHIPPED)).select(*content)
    assert cases.select(*content).exceptAll(plain).isEmpty() and cases.count() == plain.count()
