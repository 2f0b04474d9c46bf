"""Points on the boundary of a rule kill every mutant that moves it."""
from __future__ import annotations

from rulemill.operators import verify as V
from rulemill.operators.evaluate import Pack, sql_pack
from rulemill.rules.spec import SHIPPED
from rulemill.session import materialize


def test_no_operator_mutant_survives(spark):
    cases = materialize(V.boundary_cases(V.default_draws(spark, SHIPPED), SHIPPED), "cases")
    assert V.failing_cases(cases, Pack("baseline")).count() == 0
    killed = {(r.rule_name, r.mutant): r.killed for r in V.mutant_kills(cases, SHIPPED).collect()}
    assert [k for k, v in killed.items() if not v] == []
    # both packs agree on every case
    wrong = V.counterexamples(cases, Pack("baseline"), sql_pack("dbt")).collect()
    assert wrong == [] and V.equivalence(cases, Pack("baseline"), sql_pack("dbt")).where("equivalence_status = 'FAIL'").count() == 0
