"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering from labelled statistics.

`learn` covers the low-quality rows of a bounded labelled sample rule by rule. A rule grows literal by literal (the
literal with the largest gain of information on the growing part), is then pruned on the other part (literals are
dropped from its end while that does not lower its worth there), and joins the list only if it is precise on both
parts; the rows it covers are set aside. The list becomes one nested Spark conditional, so applying it is a map over
whole documents. Only statistics of the text are inputs.

Everything here is DataFrame expressions; the driver only sees histograms of features x cut points, whose size does
not depend on the data.

Defined cases: a null or empty text has statistics 0; no label, or no low-quality label, gives an empty list that
rejects nothing beyond the base rule; several labels of one document count as their least quality; labels without a
document, and null labels, are ignored; documents with the same id are judged each by its own text; columns of the
input keep their names and values, result columns that clash with them come after them in `apply` only through the
`prefix` parameter.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import held_out, read_table
from rulemill.llm.statistics import COUNTS, with_statistics
from rulemill.session import materialize

# At most so many labelled documents are learned from, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
CUTS = 24
MAX_RULES = 8
MAX_LITERALS = 3
MIN_PRECISION = 0.9
MIN_COVERED = 5

# Features are ratios of counts, so that they do not depend on the length of a text.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "n_text_chars"),
    "digit_share": ("n_digits", "n_text_chars"),
    "stops_per_word": ("n_stops", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def column(self, prefix: str = "") -> Column:
        value = feature(self.feature, prefix)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    precision: float

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column(prefix)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals))


@dataclass(frozen=True)
class DecisionList:
    """Rules in the order they are tried; the first that holds rejects a document."""
    rules: tuple[Rule, ...] = field(default=())

    def matched(self, prefix: str = "") -> Column:
        """Number of the first rule that holds, from 1; 0 if none."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(prefix), F.lit(k)).otherwise(out)
        return out


def feature(name: str, prefix: str = "") -> Column:
    part, whole = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(prefix + part).cast("double"), F.col(prefix + whole).cast("double")), F.lit(0.0))


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, bad and grow of at most `sample_rows` labelled documents, with their text; held-out ids never come in."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
             .select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).alias("__bad"),
                     (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) != 0).alias("__grow")))
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("__id"))


def _histogram(rows: DataFrame) -> dict[tuple[str, bool], list[tuple[int, int]]]:
    """For each feature and part of the sample, (good, bad) rows by bin."""
    out: dict[tuple[str, bool], list[list[int]]] = {}
    names = list(FEATURES)
    bins = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in names])
    counted = (rows.select("__grow", "__bad", F.explode(bins).alias("x"))
               .groupBy("x.f", "x.b", "__grow").agg(F.count_if("__bad").alias("bad"), F.count(F.lit(1)).alias("n")))
    for r in counted.collect():
        line = out.setdefault((r["f"], r["__grow"]), [[0, 0] for _ in range(CUTS + 1)])
        line[r["b"]][0] += r["n"] - r["bad"]
        line[r["b"]][1] += r["bad"]
    return {k: [tuple(x) for x in v] for k, v in out.items()}


def _sides(line: list[tuple[int, int]], k: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(good, bad) of the rows at or below cut k, and above it."""
    low = sum(x[0] for x in line[:k + 1]), sum(x[1] for x in line[:k + 1])
    whole = sum(x[0] for x in line), sum(x[1] for x in line)
    return low, (whole[0] - low[0], whole[1] - low[1])


def _information(good: int, bad: int) -> float:
    return math.log2(bad / (good + bad)) if bad else -60.0


def _worth(good: int, bad: int) -> float:
    return (bad - good) / (bad + good) if bad + good else -1.0


def _cut_points(sample: DataFrame) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of the two classes, so that a rare class gets cut points of its own."""
    steps = [(k + 0.5) / (CUTS // 2) for k in range(CUTS // 2)]
    found = sample.groupBy("__bad").agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in FEATURES]).collect()
    values = {n: sorted({x for r in found for x in r[n]}) for n in FEATURES}
    return {n: sorted({round((a + b) / 2, 6) for a, b in zip(v, v[1:], strict=False)}) for n, v in values.items()}


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    stats = with_statistics(labelled(docs, labels, sample_rows), prefix="s_")
    sample = stats.select("__grow", "__bad", *[feature(n, "s_").alias(n) for n in FEATURES])
    sample = materialize(sample, "quality-sample")
    cuts = _cut_points(sample)
    for n in FEATURES:
        edges = F.array(*[F.lit(x) for x in cuts[n]]).cast("array<double>")
        value = F.col(n)
        sample = sample.withColumn(f"bin_{n}", F.size(F.filter(edges, lambda e: e < value)))  # noqa: B023
    # One or two files: every step of the search reads this table.
    left = materialize(sample.select("__grow", "__bad", *[f"bin_{n}" for n in FEATURES]).coalesce(2), "quality-bins")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        found = _grow(left, cuts)
        if found is None:
            break
        rule, covered = found
        rules.append(rule)
        left = left.where(~covered)
    return DecisionList(tuple(rules))


def _grow(left: DataFrame, cuts: dict[str, list[float]]) -> tuple[Rule, Column] | None:
    steps: list[tuple[Literal, Column, tuple[int, int], tuple[int, int]]] = []
    rows, covered = left, F.lit(True)
    while len(steps) < MAX_LITERALS:
        seen = _histogram(rows)
        grown = seen.get(next(((n, True) for n in FEATURES if (n, True) in seen), ("", True)))
        if grown is None:
            break
        good, bad = sum(x[0] for x in grown), sum(x[1] for x in grown)
        if bad < MIN_COVERED or good == 0:
            break
        base, best = _information(good, bad), None
        for n in FEATURES:
            for k, cut in enumerate(cuts[n]):
                for above, (g, b) in zip((False, True), _sides(seen[n, True], k), strict=True):
                    if b >= MIN_COVERED:
                        gain = b * (_information(g, b) - base)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, n, k, above, cut, (g, b)
        if best is None or best[0] <= 1e-9:
            break
        _, n, k, above, cut, on_grow = best
        other = seen.get((n, False))
        on_prune = _sides(other, k)[above] if other else (0, 0)
        here = F.col(f"bin_{n}") > k if above else F.col(f"bin_{n}") <= k
        covered = covered & here
        rows = rows.where(here)
        steps.append((Literal(n, above, cut), covered, on_grow, on_prune))
    # Pruning: keep the prefix that is worth most on the other part, the shortest of equals.
    while len(steps) > 1 and _worth(*steps[-2][3]) >= _worth(*steps[-1][3]):
        steps.pop()
    if not steps:
        return None
    (g, b), (pg, pb) = steps[-1][2], steps[-1][3]
    if b < MIN_PRECISION * (g + b) or pb < MIN_PRECISION * (pg + pb):
        return None
    return Rule(tuple(s[0] for s in steps), b / (g + b)), steps[-1][1]


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def apply(docs: DataFrame, rules: DecisionList, prefix: str = "") -> DataFrame:
    """docs with statistics, base_failed, rule (the first learned rule that holds, 0 if none) and kept, all behind `prefix`."""
    out = with_statistics(docs, prefix=prefix)
    p = prefix
    return (out.withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}rule", rules.matched(p))
            .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}rule") == 0)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, read_table(spark, sf_dir, "labels"))
    return apply(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that the rules reject go."""
    rules = learn(docs, read_table(spark, sf_dir, "labels"))
    # A column that is not deterministic keeps the filter above the statistics; moved below, it would work them out again.
    judged = apply(docs, rules, "__q_").withColumn("__q_part", F.spark_partition_id())
    return judged.where(F.col("__q_kept") & (F.col("__q_part") >= 0)).select(*[docs[c] for c in docs.columns])
