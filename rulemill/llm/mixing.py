"""Mixing to target weights by soft membership, in DataFrame expressions only.

1. A classifier learns from a labelled table (text, domain): of a bounded sample, the words whose document frequencies
   differ most between domains, and those frequencies (naive Bayes over the presence of words). It gives every document
   a posterior over the domains; a document may belong to several.
2. Rates r >= 0 are sought whose expected totals sum(r * tokens * posterior) match the targets: least squares by
   projected gradient. The residual has one entry per domain, so a step is one sum over the corpus and one expression:
   r <- max(0, r - posterior . w), where w is the residual divided by the matrix of token-weighted posterior products.
   In the metric weighted by tokens this is a gradient step of length 1 / L.
3. A rate becomes floor(r) copies, and one more where a hash of the id falls below the fraction.

As a rate is an expression of the posterior and of the few vectors w, applying it to documents is a map without a join.

Defined cases: a null or empty text has no tokens and the posterior of a text without known words; rows of the
labelled table without a domain are ignored; no labelled row: one domain that everything belongs to, rates 1; domains
that no token can be moved to stay where they are (the residual is reported); rows with one id get the rate of their own
text and the same hash; other columns keep their names and values; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import read_table
from rulemill.session import materialize

# At most so many labelled documents are learned from, chosen by a hash of their id; so many words are used.
SAMPLE_ROWS = 6_000
N_WORDS = 64
# Evidence of words is not independent; log odds are divided by this.
TEMPER = 4.0
# Target weights are the expected shares of the domains to this power, which lifts the smaller ones.
EXPONENT = 0.7
# So much more than the least budget, as a text of mixed membership may get a rate a little below that of its domain.
HEADROOM = 1.05
STEPS = 40
TOLERANCE = 1e-6
WRITE_EVERY = 8


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    words: tuple[str, ...] = ()
    base: tuple[float, ...] = ()
    weights: tuple[tuple[float, ...], ...] = ()

    def with_posterior(self, df: DataFrame, words: str, name: str) -> DataFrame:
        """df with the probabilities of the domains, given the distinct words of a text.

        Intermediate values are columns that are used several times, so that Spark works each out once a row.
        """
        k = range(len(self.domains))
        if len(k) == 1:
            return df.withColumn(name, F.array(F.lit(1.0)))
        logits, top, parts, total = (f"{name}_{x}" for x in ("logits", "top", "parts", "total"))
        base = F.array(*[F.lit(x) for x in self.base])
        if self.words:
            known = F.array(*[F.lit(w) for w in self.words])
            table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in self.weights])
            rows = F.transform(F.array_intersect(known, F.col(words)), lambda w: F.element_at(table, F.array_position(known, w).cast("int")))
            base = F.aggregate(rows, base, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        df = df.withColumn(logits, base).withColumn(top, F.greatest(*[F.col(logits)[i] for i in k]))
        df = df.withColumn(parts, F.array(*[F.exp(F.col(logits)[i] - F.col(top)) for i in k]))
        df = df.withColumn(total, sum((F.col(parts)[i] for i in k), F.lit(0.0)))
        return df.withColumn(name, F.array(*[F.col(parts)[i] / F.col(total) for i in k])).drop(logits, top, parts, total)


def words_of(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def learn_domains(labelled: DataFrame, n_words: int = N_WORDS) -> DomainModel:
    """labelled: text and domain, a bounded sample."""
    sample = labelled.where(F.col("domain").isNotNull()).select(
        F.col("domain").cast("string").alias("domain"), F.array_distinct(words_of("text")).alias("words"))
    sample = materialize(sample.repartition(8), "labelled-words")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return DomainModel(("all",))
    domains = tuple(sorted(sizes))
    counted = sample.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    shares = [(F.col(f"n{k}") + 0.5) / (sizes[d] + 1.0) for k, d in enumerate(domains)]
    spread = F.greatest(*shares) - F.least(*shares) if len(domains) > 1 else F.lit(0.0)
    chosen = counted.orderBy(spread.desc(), "word").limit(n_words).collect()
    everything = sum(sizes.values())
    base, weights = [math.log(sizes[d] / everything) for d in domains], []
    for r in chosen:
        p = [(r[f"n{k}"] + 0.5) / (sizes[d] + 1.0) for k, d in enumerate(domains)]
        weights.append(tuple((math.log(x) - math.log1p(-x)) / TEMPER for x in p))
        base = [b + math.log1p(-x) / TEMPER for b, x in zip(base, p, strict=True)]
    return DomainModel(domains, tuple(r["word"] for r in chosen), tuple(base), tuple(weights))


def targets_of(totals: Sequence[float], weights: Sequence[float] | None = None) -> list[float]:
    """Target tokens of each domain.

    By default shares to the power EXPONENT, and HEADROOM times the tokens it takes that no domain shrinks. Given
    weights share out the tokens there are.
    """
    whole = sum(totals) or 1.0
    budget = whole
    if weights is None:
        weights = [(x / whole) ** EXPONENT for x in totals]
        budget = HEADROOM * sum(weights) * max(x / w for x, w in zip(totals, weights, strict=True) if w > 0)
    return [w * budget / (sum(weights) or 1.0) for w in weights]


def _dot(posterior: Column, weights: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        out = out + posterior[k] * F.lit(float(w))
    return out


def rate_of(posterior: Column, steps: Sequence[Sequence[float]], start: Column | None = None) -> Column:
    """The rate after the steps, each a projected move along the posterior."""
    rate = F.lit(1.0) if start is None else start
    for w in steps:
        rate = F.greatest(F.lit(0.0), rate - _dot(posterior, w))
    return rate


def solve_rates(documents: DataFrame, n_domains: int, weights: Sequence[float] | None = None) -> list[list[float]]:
    """documents: tokens and posterior. The steps that lead from rate 1 to the rates."""
    p, tokens = F.col("posterior"), F.col("tokens").cast("double")
    domains = range(n_domains)
    sums = documents.agg(*[F.sum(tokens * p[k]).alias(f"t{k}") for k in domains],
                         *[F.sum(tokens * p[k] * p[j]).alias(f"m{k}_{j}") for k in domains for j in domains if k <= j]).first()
    totals = [sums[f"t{k}"] or 0.0 for k in domains]
    if not any(totals):
        return []
    targets = np.array(targets_of(totals, weights))
    products = np.array([[sums[f"m{min(k, j)}_{max(k, j)}"] or 0.0 for j in domains] for k in domains])
    solver = np.linalg.pinv(products, rcond=1e-9)
    steps: list[list[float]] = [(solver @ (np.array(totals) - targets)).tolist()]
    state, pending = documents.select("tokens", "posterior", F.lit(1.0).alias("rate")), list(steps)
    for _ in range(STEPS):
        rate = rate_of(p, pending, F.col("rate"))
        reached = state.agg(*[F.sum(tokens * p[k] * rate).alias(f"t{k}") for k in domains]).first()
        residual = np.array([reached[f"t{k}"] or 0.0 for k in domains]) - targets
        if (np.abs(residual) <= TOLERANCE * targets.sum()).all():
            break
        steps.append((solver @ residual).tolist())
        pending.append(steps[-1])
        if len(pending) == WRITE_EVERY:
            state, pending = materialize(state.withColumn("rate", rate_of(p, pending, F.col("rate"))), "rates"), []
    return steps


def copies_of(rate: Column, doc_id: str) -> Column:
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def members(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens (words of the whole text) and posterior of every document."""
    out = docs.select("doc_id", words_of("text").alias("words"))
    return model.with_posterior(out, "words", "posterior").select("doc_id", F.size("words").cast("long").alias("tokens"), "posterior")


def labelled_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labelled table: documents of at most `sample_rows` ids of labels, with their language as domain.

    The ids are chosen before any text is read, so only they meet in one task.
    """
    marks = (labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "__id"))
    return docs.join(marks, F.col("doc_id") == F.col("__id"), "left_semi").select("text", F.col("lang").alias("domain"))


def mix_documents(docs: DataFrame, labels: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior, rate and n_copies of every document."""
    model = learn_domains(labelled_documents(docs, labels))
    known = materialize(members(docs, model), "memberships")
    steps = solve_rates(known, len(model.domains), weights)
    names = F.array(*[F.lit(d) for d in model.domains])
    best = F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int")
    return (known.withColumn("domain", F.element_at(names, best)).withColumn("rate", rate_of(F.col("posterior"), steps))
            .withColumn("n_copies", copies_of(F.col("rate"), "doc_id"))
            .select("doc_id", "tokens", "domain", "posterior", "rate", "n_copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.withColumn("posterior", F.transform("posterior", lambda x: F.round(x, 12)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: each document as often as its number of copies says; the default targets let none shrink."""
    model = learn_domains(labelled_documents(docs, read_table(spark, sf_dir, "labels")))
    steps = solve_rates(materialize(members(docs, model), "memberships"), len(model.domains))
    out = model.with_posterior(docs.withColumn("__words", words_of("text")), "__words", "__posterior")
    out = out.withColumn("__n", copies_of(rate_of(F.col("__posterior"), steps), "doc_id"))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int")))).select(*[docs[c] for c in docs.columns])
