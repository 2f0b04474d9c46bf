"""Merkle dataset manifest whose proofs come from a butterfly exchange between blocks of leaves.

1. A leaf is the digest of a row's fields. Leaves are sorted by (group, id) over range partitions; their place in their
   group comes from the partitions' row counts, so no task ever sees a whole group.
2. A block is an aligned run of FANOUT ** BLOCK_LEVELS leaves of one group; its root is hashed where its leaves lie.
3. Butterfly: in each round, aligned sets of FANOUT neighbouring subtrees swap their roots. Every block of a subtree takes
   part and hashes the parent for itself, so that after the last round every block holds the siblings of all its ancestors
   and the root of its group; nothing has to be handed down. A round is one shuffle of a few short rows a block.
4. The roots of the groups go through the same exchange to the root of all. Blocks and what they learnt are then joined, and
   each leaf gets its proof.

Defined cases: a null field is `-`; a null id comes first in its group and is never tampered; rows with one id are leaves in the
order of their digests; a null group is a group of its own, before all others; a lone leaf is the subroot, and a lone subroot
the root; an empty table gives no rows; a text of any length is one field; other columns do not matter.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import read_table
from rulemill.session import materialize

FANOUT = 2
BLOCK_LEVELS = 12
# Rounds of the exchange whose shuffles may depend on each other before their result is written.
ROUNDS_A_JOB = 8
SIBLINGS = "array<struct<at: int, others: array<string>>>"


def leaf_digest(*fields: Column) -> Column:
    """Each field is `-` if null, else its byte count, a colon and its text."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_over(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels of a tree, from its leaves to its root; with a height, a lone node is hashed on until it is reached."""
    levels = [nodes]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([joined(last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def run_of(level: list[str], place: int, fanout: int) -> tuple[int, list[str]]:
    """Where a node stands among those that are hashed with it, and the others."""
    first = place - place % fanout
    run = level[first:first + fanout]
    return place - first, run[:place - first] + run[place - first + 1:]


def folded(node: str, path: list[tuple[int, list[str]]]) -> str:
    for at, others in path:
        node = joined([*others[:at], node, *others[at:]])
    return node


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf and others) with the number of their group, their place in it, and the group's number of leaves."""
    read = materialize(leaves.withColumn("read", F.monotonically_increasing_id()), "leaves")
    order = ["grp", "id", "leaf", "read"]
    row = F.monotonically_increasing_id()
    rows = materialize(read.repartitionByRange(*order).sortWithinPartitions(*order).drop("read")
                       .withColumn("part", F.shiftright(row, 33)).withColumn("row", row), "sorted-leaves")
    counts = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("grp", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("leaves"), F.min("part").alias("part"))
    # Groups are numbered by the partition they begin in: a sum over partitions, then a rank inside each.
    begun = groups.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begun = begun.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("grp").asc_nulls_first())) - 1
    numbers = (groups.withColumn("inside", inside).join(begun, "part")
               .select(F.col("grp").alias("of"), (F.col("inside") + F.col("before")).cast("long").alias("number"), "leaves"))
    known = starts.join(numbers, F.col("grp").eqNullSafe(F.col("of"))).select(
        F.col("part").alias("in_part"), "of", "shift", "number", "leaves")
    same = (F.col("part") == F.col("in_part")) & F.col("grp").eqNullSafe(F.col("of"))
    return rows.join(known, same).withColumn("place", F.col("row") + F.col("shift")).drop("part", "in_part", "of", "row", "shift")


def blocks_of(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """One row per block: number, block, blocks of its group, and its leaves in order (fanout ** block_levels at most)."""
    size = fanout ** block_levels
    return (leaves.withColumn("block", F.floor(F.col("place") / size).cast("long"))
            .groupBy("number", "block", F.ceil(F.col("leaves") / size).cast("long").alias("blocks"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "tampered"))).alias("leaves")))


def block_roots(blocks: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("leaves").to_pylist(), batch.column("blocks").to_pylist(), strict=True)
            roots = [levels_over([x["leaf"] for x in leaves], fanout, block_levels if n > 1 else None)[-1][0] for leaves, n in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("number", "block", "blocks")), pa.array(roots, pa.string())],
                                             ["number", "block", "blocks", "node"])

    return blocks.mapInArrow(run, "number long, block long, blocks long, node string")


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """number, block, root of the group and path: the siblings of each block's ancestors, from its own up.

    nodes: number, block, blocks (of the group) and node, blocks counting from 0 without gaps. In the round of width w a block
    knows the root of its aligned w blocks. It sends it to the blocks of the fanout subtrees under its parent that stand where it
    stands in its own; the last subtree may be shorter, its blocks then answer several others.
    """
    most = nodes.agg(F.max("blocks")).first()[0] or 0
    state = nodes.select("number", "block", "blocks", "node", F.array().cast(SIBLINGS).alias("path"))
    width, rounds = 1, 0
    while width < most:
        # Group roots that are known already stay where they are.
        peers = F.expr(f"""
            if(blocks <= {width}L, array(block), filter(flatten(transform(sequence(0L, {fanout - 1}L), j -> transform(
                sequence(block % {width}L, greatest(block % {width}L, {width}L - 1L), least({width}L, blocks - own * {width}L)),
                o -> ((own div {fanout}L) * {fanout}L + j) * {width}L + o))),
            b -> b < blocks and (b div {width}L != own or b = block)))""")
        sent = state.withColumn("own", F.expr(f"block div {width}L")).select(
            "number", "blocks", "own", "node", "path", F.col("block").alias("sender"), F.explode(peers).alias("block"))
        met = sent.groupBy("number", "blocks", "block").agg(
            F.sort_array(F.collect_list(F.struct("own", "node"))).alias("run"),
            F.max(F.when(F.col("sender") == F.col("block"), F.col("path"))).alias("path"))
        at = F.expr(f"cast((block div {width}L) % {fanout}L as int)")
        others = F.expr(f"transform(filter(run, x -> x.own != block div {width}L), x -> x.node)")
        up = F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256)
        live = F.col("blocks") > width
        state = met.select(
            "number", "block", "blocks", F.when(live, up).otherwise(F.col("run")[0]["node"]).alias("node"),
            F.when(live, F.concat("path", F.array(F.struct(at.alias("at"), others.alias("others"))).cast(SIBLINGS)))
            .otherwise(F.col("path")).alias("path"))
        width *= fanout
        rounds += 1
        if rounds % ROUNDS_A_JOB == 0:
            state = materialize(state, "butterfly")
    return state.select("number", "block", F.col("node").alias("root"), "path")


PROOF_SCHEMA = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def proofs(blocks: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """One row per leaf; blocks also have the subroot, the root and the paths from the block and from its group up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PROOF_SCHEMA.split(", ")]
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                subroot, root = row["subroot"], row["root"]
                levels = levels_over([x["leaf"] for x in row["leaves"]], fanout, block_levels if row["blocks"] > 1 else None)
                upper = [(x["at"], x["others"]) for x in row["path"] + row["group_path"]]
                above = "".join(d for _, others in upper for d in others)
                out: list[list] = [[] for _ in names]
                for place, x in enumerate(row["leaves"]):
                    path, at = [], place
                    for level in levels[:-1]:
                        path.append(run_of(level, at, fanout))
                        at //= fanout
                    proof = hashlib.sha256(("".join(d for _, others in path for d in others) + above).encode()).hexdigest()
                    again = folded(folded(x["tampered"] or x["leaf"], path), upper)
                    for column, value in zip(out, (x["id"], x["leaf"], subroot, root, proof, again, again == root), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return blocks.select("leaves", "blocks", "subroot", "root", "path", "group_path").mapInArrow(run, PROOF_SCHEMA)


def manifest(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """leaves: grp, id, leaf and tampered (a digest to fold in place of the leaf, or null)."""
    blocks = materialize(blocks_of(placed(leaves.select("grp", "id", "leaf", "tampered")), fanout, block_levels), "merkle-blocks")
    lower = materialize(butterfly(block_roots(blocks, fanout, block_levels), fanout), "merkle-paths")
    subroots = lower.where(F.col("block") == 0)
    tops = subroots.select(F.lit(0).cast("long").alias("number"), F.col("number").alias("block"),
                           F.lit(subroots.count()).cast("long").alias("blocks"), F.col("root").alias("node"))
    upper = butterfly(tops, fanout).select(F.col("block").alias("number"), "root", F.col("path").alias("group_path"))
    known = lower.withColumnRenamed("root", "subroot").join(upper, "number")
    return proofs(blocks.join(known, ["number", "block"]), fanout, block_levels)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents; where 7 divides the checksum of the id, tampering adds 1 to n_chars."""
    def digest(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), digest(F.col("n_chars")).alias("leaf"),
                       F.when(tampered, digest(more)).alias("tampered"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(read_table(spark, sf_dir, "documents")))
