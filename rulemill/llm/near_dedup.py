"""Near-duplicate documents by SetSketch registers.

1. One pass turns each whole text into its set of distinct word shingles (64-bit hashes), a digest of the set and the
   sketch: register k holds floor(1 - log_b(x)) of the least of exponentially spaced values x that the elements draw for
   k, truncated to [0, q + 1]. Registers of a union are the larger of two, and equal registers are as likely as the sets
   are similar.
2. Documents with equal sets are one class; its smallest id stands for it from here on.
3. Bands of registers that agree make candidates. In a bucket every member is tied to the smallest one only, so a bucket
   of any size gives as many rows as it has members; what these ties connect is a candidate group.
4. The texts of candidate groups meet in blocks of bounded size; large groups are dealt over pairs of blocks. Within
   them the joint likelihood of the registers rules out pairs that are far from the threshold, and the others are compared on
   their full sets, most similar first. A pair that is already connected inside the block needs no comparison, so a
   block of n documents returns less than n links, but no connection is lost.
5. The components of the links, with the members of each class, are the result.

Defined cases: no words or a null text: the empty set, which is linked with nothing and kept; fewer words than a shingle
has: the whole sequence is the one shingle; rows with the same id are one vertex; rows with a null id are linked with
nothing and kept; an empty table gives no rows; other columns do not matter. A link is missed if no band agrees, which
at the threshold happens once in 1 / MISSED times for a pair without other ties, or if the likelihood estimate is
MARGIN standard deviations off.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import LOWER, mix, pieces, read_table, signed, text_bytes, word_bounds, word_hashes
from rulemill.llm.graph import components
from rulemill.session import materialize

MISSED = 1e-8
MARGIN = 6.0
BLOCK_DOCS = 512
BLOCK_SHINGLES = 400_000
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Similarity:
    """Sets are linked if 100 * intersection >= percent * union."""
    words: int = 5
    percent: int = 80
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    truncated: int = (1 << 16) - 2

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISSED) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    n_windows = max(len(h) - words + 1, 0)
    windows = np.zeros(n_windows, np.uint64)
    for k in range(words):
        windows *= _C[0]
        windows += h[k:k + n_windows]
    windows = mix(windows)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(windows[a:b - words + 1]))
        elif b > a:
            value = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                value = mix(value * _C[1] + h[k:k + 1])
            out.append(value)
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Sketcher:
    """Registers and bands of shingle sets."""

    def __init__(self, kind: Similarity):
        self.kind = kind
        rng = np.random.default_rng(7)
        self.times = rng.integers(0, 1 << 32, kind.registers, dtype=np.uint32) | np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, kind.registers, dtype=np.uint32)
        self.weights = rng.integers(1, 1 << 63, kind.rows, dtype=np.uint64) | np.uint64(1)
        self.band = rng.integers(1, 1 << 63, kind.bands, dtype=np.uint64)

    def least(self, elements: np.ndarray) -> np.ndarray:
        drawn, out = (elements >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(drawn), 1024):
            values = drawn[at:at + 1024, None] ^ self.flip
            values *= self.times
            low = values.min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def registers(self, elements: np.ndarray) -> np.ndarray:
        """Exponentially spaced, truncated minima."""
        uniform = (self.least(elements).astype(np.float64) + 0.5) / 2.0 ** 32
        spaced = -np.log1p(-uniform) / self.kind.rate
        values = np.floor(1.0 - np.log(spaced) / math.log(self.kind.base))
        return np.clip(values, 0, self.kind.truncated + 1).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(self.kind.bands, self.kind.rows).astype(np.uint64)
        return signed(mix((parts * self.weights).sum(axis=1, dtype=np.uint64) ^ self.band))


def likely_similarity(equal: np.ndarray, above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
                      base: float) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers of a are equal to, above and below those of b."""
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    high = np.minimum(u / v, v / u)
    low = np.zeros_like(high)
    shrink = (base - 1.0) / base

    def p(x):
        return np.clip(-np.log1p(-shrink * np.clip(x, 0.0, 1.0)) / math.log(base), 1e-12, 1.0)

    def likelihood(j):
        pa, pb = p(u - v * j), p(v - u * j)
        return above * np.log(pa) + below * np.log(pb) + equal * np.log(np.clip(1.0 - pa - pb, 1e-12, 1.0))

    for _ in range(40):
        third = (high - low) / 3.0
        rising = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(rising, low + third, low), np.where(rising, high, high - third)
    return (low + high) / 2.0


def links_within(ids: list[int], sides: list[int], sets: list[np.ndarray], across: bool, sketcher: Sketcher) -> list[tuple[int, int]]:
    """Links that connect what the linked pairs of a block connect; `across`: only pairs of the two sides count."""
    kind, n = sketcher.kind, len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    registers = np.stack([sketcher.registers(s) for s in sets])
    side = np.array(sides)
    m, t = kind.registers, kind.percent / 100
    deviation = math.sqrt(t * (1 - t) / m)
    found = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if across:
            j = j[side[j] != side[i]]
        j = j[np.minimum(sizes[j], sizes[i]) >= t * np.maximum(sizes[j], sizes[i]) - 1e-9]
        if not len(j):
            continue
        equal = (registers[j] == registers[i]).sum(axis=1)
        j = j[equal >= m * (t - (MARGIN + 1) * deviation)]
        if not len(j):
            continue
        equal = (registers[j] == registers[i]).sum(axis=1)
        above = (registers[j] < registers[i]).sum(axis=1)
        likely = likely_similarity(equal, above, m - equal - above, np.full(len(j), sizes[i]), sizes[j], kind.base)
        near = likely >= t - MARGIN * deviation
        found.append(np.stack([likely[near], np.full(int(near.sum()), i), j[near]], axis=1))
    links: list[tuple[int, int]] = []
    if not found:
        return links
    pairs = np.concatenate(found)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:].astype(np.int64).tolist():
        a, b = root(i), root(j)
        if a == b:
            continue
        at = np.minimum(np.searchsorted(sets[i], sets[j]), len(sets[i]) - 1)
        shared = int((sets[i][at] == sets[j]).sum())
        if 100 * shared >= kind.percent * (len(sets[i]) + len(sets[j]) - shared):
            parent[a] = b
            links.append((ids[i], ids[j]))
    return links


SKETCH_SCHEMA = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def sketches(docs: DataFrame, kind: Similarity) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(kind)
        empty = np.empty(0, np.int64)
        for part in pieces(batches):
            sets = shingle_sets(*text_bytes(part.column("text")), kind.words)
            first = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            second = np.array([np.bitwise_xor.reduce(mix(s ^ _C[2])) for s in sets], np.uint64)
            bands = [sketcher.bands(sketcher.registers(s)) if len(s) else empty for s in sets]
            lengths = np.cumsum([0] + [len(b) for b in bands])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(first)), pa.array(signed(second)),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH_SCHEMA)


def _block_links(texts: DataFrame, kind: Similarity) -> DataFrame:
    """texts: doc_id, text, side and the keys g, i, j of a block; rows of a block lie together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(kind)
        key, ids, sides, sets = None, [], [], []

        def ended() -> list[tuple[int, int]]:
            return links_within(ids, sides, sets, key[1] != key[2], sketcher) if len(ids) > 1 else []

        def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for part in pieces(batches):
            links = []
            found = shingle_sets(*text_bytes(part.column("text")), kind.words)
            rows = zip(*(part.column(c).to_pylist() for c in ("g", "i", "j", "side", "doc_id")), found, strict=True)
            for g, i, j, side, doc_id, elements in rows:
                if (g, i, j) != key:
                    if key is not None:
                        links += ended()
                    key, ids, sides, sets = (g, i, j), [], [], []
                ids.append(doc_id)
                sides.append(side)
                sets.append(elements)
            yield made(links)
        if key is not None:
            yield made(ended())

    return texts.select("g", "i", "j", "side", "doc_id", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, kind: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(sketches(docs, kind), "sketches")
    digest = ["digest_a", "digest_b", "n_shingles"]
    classes = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*digest).agg(F.min("doc_id").alias("stands"))
    member = sketched.join(classes, digest, "left")
    standing = member.where(F.col("doc_id") == F.col("stands"))

    buckets = standing.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    hubs = (buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most"))
            .where(F.col("hub") < F.col("most")).drop("most"))
    ties = buckets.join(hubs, "bucket").where(F.col("doc_id") != F.col("hub")).select("doc_id", "hub").distinct()
    groups = materialize(components(ties, "doc_id", "hub"), "candidate-groups")

    sized = (groups.join(standing.select(F.col("doc_id").alias("id"), "n_shingles").distinct(), "id")
             .groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
             .select("component", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = (groups.join(sized, "component")
             .select("id", F.col("component").alias("g"), own.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
             .select("id", "g", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
    texts = (docs.join(dealt, docs["doc_id"] == dealt["id"]).drop("id")
             .repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id"))
    linked = components(_block_links(texts, kind), "a", "b").withColumnRenamed("id", "stands")

    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "stands", "doc_id"))
    return member.join(linked, "stands", "left").select(
        "doc_id", "n_shingles", whole.alias("component_id"),
        F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), Similarity(words=3, percent=85))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one document of each group of five-word, 0.8-similar texts stays, that of the smallest id.

    Rows with the id that stays but unlike texts all stay; of rows with one id and one text the least by the other columns, in
    their order, stays; rows without an id stay as they are.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    one = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        one = one.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__least"))
        one = one.select("doc_id", "text", *(F.col("__least")[c].alias(c) for c in others))
    else:
        one = one.distinct()
    return one.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
