"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

`cos(x W + b)` with Gaussian W approximates a Gaussian kernel over the standardised statistics x. Each partition of the
labelled sample sums its own normal equations; Spark adds the cells up, and the driver solves a system whose size is the
number of features. The ridge scores of rows that took no part in the fit are counted in score bins, and pooling
adjacent violators over the bins gives a rising step from score to probability, which is applied by interpolation.

Learned from: at most SAMPLE_ROWS rows of labels, chosen by a hash of their id, none of them held out (crc32 of the id
as text, modulo 4, is 2). Inputs of a score: statistics of the text only.

Defined cases: a null or empty text has statistics 0 and is scored like any other; no usable label: every score is 0.5;
labels of one class only: every score is that class; several labels of one id count as the least; labels without a
document and null labels are ignored; rows with one id are scored each by its text; other columns do not matter.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import held_out, read_table
from rulemill.llm.statistics import COUNTS, MORE_COUNTS, with_statistics
from rulemill.session import materialize

SAMPLE_ROWS = 40_000
SAMPLE_PARTITIONS = 8
N_FEATURES = 256
RIDGE = 1e-3
BINS = 512
CLIP = 6.0
THRESHOLD = 0.7

_RATIOS = (
    ("n_symbols", "n_words"), ("word_chars", "n_words"), ("n_distinct_words", "n_words"), ("n_upper", "n_text_chars"),
    ("n_digits", "n_text_chars"), ("n_stops", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
    ("n_lines", "n_words"),
)


def inputs() -> Column:
    """The statistics a score is made from, none of which grows with the text without bound."""
    ratios = [F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for a, b in _RATIOS]
    return F.array(*ratios, F.log1p(F.col("n_words").cast("double")), F.log1p(F.col("longest_word").cast("double")))


@dataclass(frozen=True)
class KernelModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    points: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        out = np.ones((len(x), len(self.shift) + 1))
        out[:, 1:] = np.cos(z @ self.weights + self.shift) * np.sqrt(2.0 / len(self.shift))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.points, self.values), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def rising(points: np.ndarray, rates: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising sequence closest to the rates in counted squares."""
    blocks: list[list[float]] = []
    for rate, n in zip(rates, counts, strict=True):
        blocks.append([rate, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            rate, n, k = blocks.pop()
            low = blocks[-1]
            low[0] = (low[0] * low[1] + rate * n) / (low[1] + n)
            low[1] += n
            low[2] += k
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _normal_equations(sample: DataFrame, model: KernelModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over the fitting part, cell by cell."""
    size = len(model.shift) + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("x")))
                square += z.T @ z
                right += z.T @ batch.column("y").to_numpy()
        cells = np.concatenate([square[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    sums = np.zeros(len(upper[0]) + size)
    summed = sample.where("fit").select("x", "y").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    for row in summed.collect():  # as many rows as the system has cells
        sums[row["cell"]] = row["value"]
    square = np.zeros((size, size))
    square[upper] = sums[:len(upper[0])]
    return square + np.triu(square, 1).T, sums[len(upper[0]):]


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES) -> KernelModel | None:
    """stats: doc_id and x. None if no label can be used."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "__id"))
    sample = stats.join(marks, F.col("doc_id") == F.col("__id")).select(
        "x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) != 0).alias("fit"))
    sample = materialize(sample.repartition(SAMPLE_PARTITIONS), "labelled-statistics")
    width = len(_RATIOS) + 2
    moments = sample.where("fit").agg(
        F.count(F.lit(1)).alias("n"), *[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(23)
    scale = np.array([moments[f"s{k}"] for k in range(width)])
    model = KernelModel(
        np.array([moments[f"m{k}"] for k in range(width)]), np.where(scale > 1e-9, scale, 1.0),
        rng.standard_normal((width, n_features)) * 1.5 / np.sqrt(width), rng.uniform(0, 2 * np.pi, n_features),
        np.zeros(n_features + 1), np.zeros(1), np.full(1, 0.5))
    square, right = _normal_equations(sample, model)
    ridge = np.linalg.solve(square + RIDGE * moments["n"] * np.eye(len(right)) / n_features, right)
    model = KernelModel(model.mean, model.scale, model.weights, model.shift, ridge, model.points, model.values)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x"))) if batch.num_rows else np.empty(0)
            bins = np.clip(((raw + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    rows = (sample.where(~F.col("fit")).select("x", "y").mapInArrow(binned, "bin long, raw double, y double")
            .groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    if not rows:
        return model
    points, rates, counts = (np.array([r[c] for r in rows], float) for c in ("raw", "y", "n"))
    return KernelModel(model.mean, model.scale, model.weights, model.shift, ridge, points, rising(points, rates, counts))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = with_statistics(docs.select("doc_id", "text")).select("doc_id", inputs().alias("x"), *COUNTS, *MORE_COUNTS).select("doc_id", "x")
    stats = materialize(stats, "document-statistics")
    model = learn(stats, labels)
    if model is None:
        scored = stats.select("doc_id", F.lit(0.5).alias("score"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

        scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
