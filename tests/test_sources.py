"""Comparison of verdict sources with any names and in any number."""
from __future__ import annotations

import pytest

from rulemill.operators.compare import rule_frame
from rulemill.operators.evaluate import Pack, sql_pack
from rulemill.plans import workflows as W
from rulemill.registry.adapter import products
from rulemill.sources import ingest as I

SF_DIR = "/root/testdata/sf0.001"


def _compared(spark, packs, providers):
    base = Pack("baseline")
    table = products(spark, SF_DIR)
    return W.run_comparison(table, base, packs, W.conversions(spark, base.rules, providers))


def test_a_fourth_source_is_lined_up(spark):
    names = ("python", "dbt", "soda", "audit")
    packs = [Pack("python"), *map(sql_pack, names[1:])]
    out = _compared(spark, packs, {"python": "groq", "dbt": "dbt_core", "soda": "soda_core", "audit": "audit_core"})
    rows = out.comparison.collect()
    assert len(rows) == len(Pack("baseline").rules)
    assert all(r[n] is not None and r[n]["source"] == n for r in rows for n in names)
    assert {f"{n}_status" for n in names} <= set(rule_frame(out.comparison).columns)


def test_one_renamed_source_decides_every_rule(spark):
    for pack in (sql_pack("audit"), Pack("audit")):
        out = _compared(spark, [pack], {"audit": "audit_core"})
        rows = out.comparison.collect()
        assert len(rows) == len(Pack("baseline").rules)
        assert {r.best_engine for r in rows} == {"audit"} and all(r.migration_state for r in rows)
        assert all(r.python is None and r.dbt is None for r in rows)


def test_normalized_lines_are_kept_or_fail(spark, tmp_path):
    def read(*lines):
        path = tmp_path / str(len(list(tmp_path.iterdir())))
        path.write_text("\n".join(lines) + "\n")
        return I.scan_products_jsonl(spark, str(path))

    good = ('{"product_id": "a", "fat": 1.5, "other": [1, {}]}', "", " \t ", '{"product_id": null, "fat": 2}', '{"fat": 3}', "{}")
    rows = read(*good)
    assert sorted((r.product_id or "", r.fat or 0.0) for r in rows.collect()) == [("", 0.0), ("", 2.0), ("", 3.0), ("a", 1.5)]
    assert rows.count() == 4
    for bad in ('{"product_id": "b"', "word", "null", "5", '[{"product_id": "b"}]', '{"fat": 1} {"fat": 2}', '{"fat": 1}, {"fat": 2}', '{"fat": 1}],[{"fat": 2}',
                '{"fat": "much"}'):
        for act in ("collect", "count"):
            with pytest.raises(Exception, match="(?i)malformed|not one JSON object"):
                getattr(read(*good, bad).select("fat"), act)()
