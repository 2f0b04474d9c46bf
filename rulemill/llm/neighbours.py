"""Approximate nearest neighbours with a hash-prefix forest.

A tree is a sorted array of long hash strings: bit k is the side of a random hyperplane that a vector lies on. The more
leading bits two vectors share, the nearer they tend to be. A query descends every tree to its longest prefix match and
then ascends all trees together, one bit at a time, until the subtrees above its matches hold `reach` rows in all; those
are its candidates, and the exact inner product ranks them.

As inner products are wanted, an indexed vector gets one more component that brings all of them to the greatest norm
(0 for queries); the angle then orders like the product.

1. Rows that repeat an id with its vector are dropped. Equal vectors: only the k + 1 smallest ids of a group can be in any
   answer, so the others are not indexed (a ranking that Spark limits before its shuffle). They still are queries.
2. `reach` and the sizes of subtrees count ids: each of m vectors of one id counts 1/m, so a subtree never counts more
   ids than it has. `reach` is fitted on at most SAMPLE_QUERIES queries compared with all rows: the least reach whose recall is FIT_RECALL.
3. The level that each query ascends to comes from counts by tree, level and prefix, for each vector of a query by itself.
4. Rows and queries meet by tree and the shortest prefix that a query needs. A cell with many rows or queries is dealt
   over blocks of bounded size, which keeps every candidate. Each block returns at most k ids a query, each with
   its nearest vector there.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component takes no part, nor does a row
without an id or with another length than most have (the longer of equals); of rows with one id the nearest counts; a
query's own id is no candidate; fewer than k candidates: all of them; ties go to the smaller id; an empty table gives no
rows; other columns do not matter.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import read_table
from rulemill.session import broadcast_if_small, materialize

TREES = 32
BITS = 48
NEIGHBOURS = 20
SAMPLE_QUERIES = 64
FIT_RECALL = 0.97
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
# What an id counts in all; its vectors share it.
UNIT = 1 << 20
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Forest:
    """planes: (dimensions + 1) x (trees * bits)."""
    planes: np.ndarray
    norm: float
    trees: int
    bits: int

    def codes(self, vectors: np.ndarray, indexed: bool) -> np.ndarray:
        """rows x trees hash strings, as integers whose highest bit is the first."""
        lift = np.zeros((len(vectors), 1))
        if indexed:
            lift[:, 0] = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(axis=1), 0.0))
        sides = np.concatenate([vectors, lift], axis=1) @ self.planes > 0
        weights = np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return (sides.reshape(len(vectors), self.trees, self.bits) * weights).sum(axis=2)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size(v) == (length["n"] if length else 0))


def shares(rows: DataFrame) -> DataFrame:
    """The rows, which are distinct, with the part of UNIT that each counts among the rows of its id."""
    marks = rows.select("vec_id", F.xxhash64("embedding").alias("mark")).distinct()
    several = materialize(marks.groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    if several.isEmpty():
        return rows.withColumn("share", F.lit(UNIT).cast("long"))
    return rows.join(broadcast_if_small(several), "vec_id", "left").withColumn(
        "share", F.floor(F.lit(UNIT) / F.coalesce("m", F.lit(1))).cast("long")).drop("m")


def first_distinct(ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k distinct ids."""
    if len(np.unique(ids[:k])) == len(ids[:k]):
        return np.arange(len(ids[:k]))
    return np.sort(np.unique(ids, return_index=True)[1])[:k]


def with_codes(rows: DataFrame, forest: Forest, indexed: bool) -> DataFrame:
    kind = rows.schema["embedding"].dataType.simpleString()
    other = "share" if indexed else "mark"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = forest.codes(_vectors(part.column("embedding")), indexed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("embedding"), part.column(other), _lists(codes)], ["vec_id", "embedding", other, "codes"])

    return rows.select("vec_id", "embedding", other).mapInArrow(run, f"vec_id long, embedding {kind}, {other} long, codes array<long>")


def shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """How many leading bits two arrays of hash strings share."""
    different = np.bitwise_xor(a, b)
    length = np.zeros(different.shape, np.int64)
    some = different > 0
    length[some] = np.floor(np.log2(different[some].astype(np.float64))).astype(np.int64) + 1
    return bits - length


def fit_reach(index: DataFrame, queries: DataFrame, forest: Forest, k: int) -> int:
    """The least number of ids (in parts of UNIT), summed over the trees, that the sampled queries need for FIT_RECALL."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    vectors = np.array([r["embedding"] for r in sample], np.float64)
    codes = np.array([r["codes"] for r in sample], np.int64)
    bits = forest.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ids), bits + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = part.column("vec_id").to_numpy()
                share = np.repeat(part.column("share").to_numpy(), forest.trees)
                scores = _vectors(part.column("embedding")) @ vectors.T
                listed = part.column("codes").flatten().to_numpy().reshape(part.num_rows, -1)
                out: list[list] = [[], [], [], []]
                for q in range(len(ids)):
                    levels = shared_bits(listed, codes[q], bits)
                    counts[q] += np.bincount(levels.ravel(), share, bits + 1).astype(np.int64)
                    others = np.flatnonzero(own != ids[q])
                    best = others[np.argsort(-scores[others, q], kind="stable")]
                    best = best[first_distinct(own[best], k)]
                    for column, values in zip(out, (np.full(len(best), q), own[best], scores[best, q], levels[best].max(axis=1)), strict=True):
                        column.append(values)
                query, vec, score, level = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score), pa.array(level), pa.array(np.zeros(len(vec), np.int64))], names)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.nulls(len(at[0]), pa.int64()), pa.nulls(len(at[0]), pa.float64()), pa.array(at[1]), pa.array(counts[at])], names)

    names = ["q", "vec_id", "score", "level", "n"]
    seen = materialize(index.mapInArrow(run, "q long, vec_id long, score double, level long, n long"), "reach-sample")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    of_ids = seen.where("vec_id is not null").groupBy("q", "vec_id").agg(F.max(F.struct("score", "level")).alias("top")).select("q", "vec_id", "top.*")
    best = of_ids.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k).groupBy("q", "level").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = seen.where("vec_id is null").groupBy("q", "level").agg(F.sum("n").alias("n")).collect()
    held, near = np.zeros((len(ids), bits + 1)), np.zeros((len(ids), bits + 1))
    for r in sizes:
        held[r["q"], r["level"]] = r["n"]
    for r in best:
        near[r["q"], r["level"]] = r["n"]
    held, near = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (held, near))  # at this level or deeper
    rows = np.arange(len(ids))
    for reach in np.unique(held):
        level = bits - np.argmax(held[:, ::-1] >= min(reach, held[:, 0].min()), axis=1)
        if (near[rows, level] / np.maximum(near[:, 0], 1)).mean() >= FIT_RECALL:
            return int(reach)
    return int(held.max(initial=0))


def _subtree_sizes(index: DataFrame, bits: int, top: int) -> DataFrame:
    """Ids (in parts of UNIT) by tree, level (1 to top) and prefix, summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, -1)
            share = batch.column("share").to_numpy()
            for level in range(1, top + 1):
                for tree in range(codes.shape[1]):
                    prefix, at = np.unique(codes[:, tree] >> (bits - level), return_inverse=True)
                    n = np.bincount(at, share)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), tree)), pa.array(np.full(len(n), level)), pa.array(prefix), pa.array(n.astype(np.int64))],
                        ["tree", "level", "prefix", "n"])

    return (index.select("codes", "share").mapInArrow(run, "tree long, level long, prefix long, n long")
            .groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n")))


def _block_answers(forest: Forest, k: int):
    """The nearest candidates of the queries in one block: sorted hash strings, and a slice of them for each query."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rows, queries = block.filter(block.column("ascent").is_null()), block.filter(block.column("ascent").is_valid())
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if rows.num_rows and queries.num_rows:
            strings = rows.column("code").to_numpy()
            order = np.argsort(strings, kind="stable")
            strings = strings[order]
            ids = rows.column("vec_id").to_numpy()[order]
            vectors = _vectors(rows.column("embedding").combine_chunks())[order]
            q_ids, q_codes, levels = (queries.column(c).to_numpy() for c in ("vec_id", "code", "ascent"))
            q_vectors = _vectors(queries.column("embedding").combine_chunks())
            shift = forest.bits - levels
            low = q_codes >> shift << shift
            first = np.searchsorted(strings, low)
            last = np.searchsorted(strings, low + (np.int64(1) << shift))
            for q in range(len(q_ids)):
                near = vectors[first[q]:last[q]] @ q_vectors[q]
                own = ids[first[q]:last[q]]
                near = np.where(own == q_ids[q], -np.inf, near)
                if len(near) > k:
                    at = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9)
                    if len(np.unique(own[at])) < k:  # vectors of one id
                        at = np.arange(len(near))
                else:
                    at = np.arange(len(near))
                at = at[near[at] > -np.inf]
                exact = (vectors[first[q]:last[q]][at] * q_vectors[q]).sum(axis=1)
                best = np.lexsort((own[at], -exact))
                best = best[first_distinct(own[at][best], k)]
                for column, values in zip(out, (np.full(len(best), q_ids[q]), own[at][best], exact[best]), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score; both tables have vec_id and embedding."""
    spark = embeddings.sparkSession
    rows, asked = (usable(t).dropDuplicates(["vec_id", "embedding"]) for t in (embeddings, queries))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size"), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    rng = np.random.default_rng(5)
    forest = Forest(rng.standard_normal((facts["size"] + 1, trees * bits)), math.sqrt(facts["square"]), trees, bits)
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= k + 1).drop("__r")
    index = materialize(with_codes(shares(indexed), forest, True), "forest")
    asked = asked.where(F.size("embedding") == facts["size"]).withColumn("mark", F.xxhash64("embedding"))
    asked = materialize(with_codes(asked, forest, False), "queries")
    reach = max(fit_reach(index, asked, forest, k), trees * (k + 1) * UNIT)

    top = max(1, min(bits, math.ceil(math.log2(max(2.0, facts["n"] * trees * UNIT / reach))) + 6))
    sizes = materialize(_subtree_sizes(index, bits, top), "subtrees")
    strings = asked.select("vec_id", "mark", F.posexplode("codes").alias("tree", "code"))
    paths = strings.select("vec_id", "mark", F.col("tree").cast("long").alias("tree"), "code", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(top).cast("long"))).alias("level"))
    paths = paths.withColumn("prefix", F.expr(f"shiftright(code, CAST({bits} - level AS INT))"))
    enough = (paths.join(sizes, ["tree", "level", "prefix"]).groupBy("vec_id", "mark", "level").agg(F.sum("n").alias("n"))
              .where(F.col("n") >= reach).groupBy("vec_id", "mark").agg(F.max("level").alias("ascent")))
    ascents = materialize(asked.select("vec_id", "mark").distinct().join(enough, ["vec_id", "mark"], "left").select("vec_id", "mark", F.coalesce("ascent", F.lit(0)).cast("long").alias("ascent")), "ascents")
    cell_level = ascents.agg(F.min("ascent")).first()[0]
    if cell_level is None:
        return spark.createDataFrame([], RESULT)
    shift = bits - cell_level

    def strings_of(table: DataFrame) -> DataFrame:
        out = table.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes")
        return out.withColumn("cell", F.shiftright("code", shift)).withColumn("tree", F.col("tree").cast("long"))

    of_queries = strings_of(asked.join(ascents, ["vec_id", "mark"]))
    of_rows = strings_of(index)
    cells = (of_rows.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nr"))
             .join(of_queries.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("nq")), ["tree", "cell"]))
    cells = materialize(cells, "cells")

    def dealt(table: DataFrame, own: str, other: str, ascent) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id", "embedding"), F.col(own)).cast("int")
        out = table.join(cells, ["tree", "cell"]).withColumn(f"b{own}", part)
        out = out.withColumn(f"b{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return out.select("tree", "cell", "bnr", "bnq", "vec_id", "code", "embedding", ascent.cast("long").alias("ascent"))

    both = dealt(of_rows, "nr", "nq", F.lit(None)).unionByName(dealt(of_queries, "nq", "nr", F.col("ascent")))
    found = both.groupBy("tree", "cell", "bnr", "bnq").applyInArrow(_block_answers(forest, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
