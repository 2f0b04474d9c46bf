"""Evaluate rule packs: every rule of every pack in one scan of the products."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.functions.text import blank_sql
from rulemill.operators.ranking import first_n_per_key
from rulemill.rules.spec import SHIPPED, Rule, quoted
from rulemill.schemas import VERDICT_SCHEMA


@dataclass(frozen=True)
class Pack:
    """A verdict source: specs with a notion of blank, or the SQL condition texts of the specs."""

    source: str
    rules: tuple[Rule, ...] = SHIPPED
    blank: Callable[[str], str] = blank_sql
    sql: bool = False

    def predicates(self) -> dict[str, str]:
        """A never-null boolean SQL expression per rule."""
        if self.sql:
            return {r.rule_name: f"coalesce({r.sql_condition}, false)" for r in self.rules}
        return {r.rule_name: r.expression(self.blank) for r in self.rules}


def sql_pack(source: str, rules: Sequence[Rule] = SHIPPED) -> Pack:
    """A pack whose conditions are SQL texts, where blank means spaces only."""
    return Pack(source, tuple(rules), sql=True)


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits(named: Sequence[tuple[str, str]]) -> str:
    """SQL for the names whose predicate holds, in order. array_remove, unlike filter, stays in generated code."""
    tests = ", ".join(f"CASE WHEN {p} THEN {text_literal(name)} ELSE '' END" for name, p in named)
    return f"array_remove(array({tests}), '')"


WORD = 62  # rules per signature word


def signature_word(preds: Sequence[str | None]) -> str:
    """SQL for up to WORD verdicts of one product as the bits of a long."""
    bits = [f"CASE WHEN {p} THEN {1 << i}L ELSE 0L END" for i, p in enumerate(preds) if p is not None]
    return " | ".join(bits) or "0L"


def product_tags(products: DataFrame, pack: Pack) -> DataFrame:
    """Tags per product in rule order, an empty array when clean."""
    preds = pack.predicates()
    tags = hits([(r.tag, preds[r.rule_name]) for r in pack.rules])
    return products.selectExpr("product_id", f"{tags} AS tags")


def rule_verdicts(products: DataFrame, *packs: Pack) -> DataFrame:
    """Long verdicts (source, rule_name, product_id) of all packs from one scan."""
    if len(packs) == 1:
        names = hits(list(packs[0].predicates().items()))
        return products.selectExpr(
            f"{text_literal(packs[0].source)} AS source", f"explode({names}) AS rule_name", "product_id")
    keyed = [(f"{pack.source}\n{name}", p) for pack in packs for name, p in pack.predicates().items()]
    return products.selectExpr(f"explode({hits(keyed)}) AS key", "product_id").selectExpr(
        "split_part(key, '\\n', 1) AS source", "split_part(key, '\\n', 2) AS rule_name", "product_id")


def violation_rows(products: DataFrame, pack: Pack) -> DataFrame:
    """Full product rows once per violated rule."""
    names = hits(list(pack.predicates().items()))
    return products.selectExpr(f"explode({names}) AS rule_name", *[quoted(c) for c in products.columns])


def count_violations(products: DataFrame, pack: Pack) -> DataFrame:
    """Violating rows per rule: one aggregate row, then unpivoted. Nothing but that row is shuffled."""
    preds = pack.predicates()
    counts = products.selectExpr(*[f"count_if({p}) AS {quoted(name)}" for name, p in preds.items()])
    pairs = ", ".join(f"{text_literal(name)}, {quoted(name)}" for name in preds)
    return counts.selectExpr(f"stack({len(preds)}, {pairs}) AS (rule_name, violations)")


def sample_violations(products: DataFrame, pack: Pack, limit: int = 5) -> DataFrame:
    """The first violating rows of every rule by product id."""
    rows = violation_rows(products, pack)
    return first_n_per_key(rows, ["rule_name"], [F.col("product_id")], limit, ["product_id"])


def tags_from_verdicts(verdicts: DataFrame, products: DataFrame, rules: DataFrame) -> DataFrame:
    """Long verdicts back to tags per product in rule order; clean products keep an empty array.

    A product holds at most one verdict per rule, so a group is never larger than the pack.
    """
    small = F.broadcast(rules.select("rule_name", "rule_order", "tag"))
    grouped = (
        verdicts.select("rule_name", "product_id").distinct()
        .join(small, "rule_name")
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("rule_order", "tag"))).alias("hits"))
    )
    return products.select("product_id").join(grouped, "product_id", "left").select(
        "product_id",
        F.coalesce(F.col("hits.tag"), F.array().cast("array<string>")).alias("tags"),
    )


def verdicts_from_functions(
    products: DataFrame,
    checks: Mapping[str, Callable[[pd.DataFrame], pd.Series]],
    source: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Verdicts of user-supplied vectorized checks, a batch at a time; each takes and returns whole columns."""
    names = list(checks)
    functions = [checks[name] for name in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, check in zip(names, functions):
                hit = check(batch).fillna(False).astype(bool)
                ids = batch.loc[hit, "product_id"]
                yield pd.DataFrame({"source": source, "rule_name": name, "product_id": ids})

    needed = products if columns is None else products.select("product_id", *columns)
    return needed.mapInPandas(run, VERDICT_SCHEMA)
