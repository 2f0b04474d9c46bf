"""WARC fixity audit by Merkle trees over records and their ordered offset ranges.

Records lie in archive files in the order of their position, RECORDS_PER_FILE positions to a file, each at the offset
behind those before it. A leaf is the digest of a record's place (file, offset, length) and bytes. A node is the digest
of up to FANOUT children in order, level by level up to one root. Two replicas are compared from the root down: only
children of nodes that differ are looked at, so a sound replica costs one comparison and a damaged record costs one
node a level.

Everything is DataFrame expressions: a level is an aggregate of the one below it, with FANOUT children a group, and a
step of the descent joins the children of differing nodes.

Defined cases: a null url or html is empty; a record without a position is not audited; records that share a position
are one leaf (their digests in order); no records: no rows; a record that only one replica has is `missing` or `extra`;
a record whose range differs is `range`, one whose bytes differ `content`; other columns do not matter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import read_table
from rulemill.session import materialize

FANOUT = 32
RECORDS_PER_FILE = 1024


def record_bytes(url: Column, html: Column, position: Column) -> Column:
    """A response record: its header, the page and the closing line ends."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), position.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """position, file, offset, length and digest of the record of each page."""
    position = F.col("page_id").cast("long")
    rows = pages.where(F.col("page_id").isNotNull()).select(position.alias("position"), record_bytes(F.col("url"), F.col("html"), position).alias("r"))
    rows = rows.select("position", F.floor(F.col("position") / RECORDS_PER_FILE).alias("file"),
                       F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("position", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("position", "file", "offset", "length", "digest")


def _joined(name: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("child", name))), lambda x: x[name]), ","), 256)


def tree(records: DataFrame) -> list[DataFrame]:
    """Tables (node, digest) of each level, from the leaves to the root; each is written once."""
    placed = F.sha2(F.concat_ws(":", "file", "offset", "length", "digest"), 256)
    leaves = records.select(F.col("position").alias("node"), F.col("offset").alias("child"), placed.alias("digest"))
    levels = [materialize(leaves.groupBy("node").agg(_joined("digest").alias("digest")), "merkle-level")]
    while True:
        span = levels[-1].agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
        if span["low"] is None or span["low"] == span["high"]:
            return levels
        children = levels[-1].select(F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("child"), "digest")
        levels.append(materialize(children.groupBy("node").agg(_joined("digest").alias("digest")), "merkle-level"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), "node", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def _under(level: DataFrame, parents: DataFrame) -> DataFrame:
    return level.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(
        parents.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent")


def locate(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Positions (node) of the leaves that differ. Trees of unlike height are compared from the lower root's level down."""
    top = min(len(ours), len(theirs)) - 1
    found = materialize(_differing(ours[top], theirs[top]), "merkle-differing")
    for level in range(top - 1, -1, -1):
        if found.isEmpty():
            break
        found = materialize(_differing(_under(ours[level], found), _under(theirs[level], found)), "merkle-differing")
    return found


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Damaged records of a replica: position, file, offset, length (ours where we have the record) and status."""
    ours, theirs = materialize(ours, "manifest"), materialize(theirs, "manifest")
    spots = locate(tree(ours), tree(theirs)).withColumnRenamed("node", "position")
    place = ("file", "offset", "length")

    def side(records: DataFrame, mark: str) -> DataFrame:
        found = records.join(spots, "position", "left_semi")
        number = F.row_number().over(Window.partitionBy("position").orderBy("offset", "digest"))
        return found.select("position", number.alias("k"), F.struct(*place).alias(f"{mark}_place"), F.col("digest").alias(f"{mark}_digest"))

    both = side(ours, "a").join(side(theirs, "b"), ["position", "k"], "full")
    status = (F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra")
              .when(F.col("a_place") != F.col("b_place"), "range").when(F.col("a_digest") != F.col("b_digest"), "content"))
    at = F.coalesce("a_place", "b_place")
    return both.select("position", *[at[c].alias(c) for c in place], status.alias("status")).where(F.col("status").isNotNull())


def damaged(records: DataFrame) -> DataFrame:
    """A replica of a manifest as a store with faults would hold it: some records altered in place, some lost."""
    fault = F.crc32(F.col("position").cast("string").cast("binary"))
    return records.where(fault % 211 != 3).withColumn(
        "digest", F.when(fault % 53 == 7, F.sha2(F.concat("digest", F.lit("*")), 256)).otherwise(F.col("digest")))


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with faults: every damaged record and where it lies."""
    records = manifest(read_table(spark, sf_dir, "pages"))
    return audit(records, damaged(records)).withColumnRenamed("position", "page_id")
