"""What the two substring operators share: texts under a key, exact copies, and anchors that point to repeated windows.

A window is `length` consecutive symbols (words or bytes) of one document. Its anchor is the least hash (48 bits of it)
of the `gram`-symbol pieces inside it, so equal windows have equal anchors, and neighbouring windows mostly share one: a
document has far fewer anchors than windows. Only windows whose anchor occurs in two documents can repeat, and only
those are looked at further.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulemill.llm.common import mix, pieces, prefix_hashes, range_hashes, rows_of, signed, text_bytes

# From bytes and row offsets to symbol values and row offsets in them.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
KEY = ["doc_id", "signature"]
ANCHOR_SHIFT = np.uint64(16)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, signature and text; the signature tells rows with one id but different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("signature"), text.alias("text"))


def copies(texts: DataFrame) -> DataFrame:
    """Keys of texts that a row with a smaller id holds exactly. They can neither keep a window nor be the first to have one."""
    whole = ["signature", "second", "n"]
    digests = texts.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "signature", F.xxhash64("text", F.lit(1)).alias("second"), F.length("text").alias("n"))
    least = digests.groupBy(*whole).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where(F.col("least") < F.col("most"))
    return digests.join(least, whole).where(F.col("doc_id") > F.col("least")).select(*KEY).distinct()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:len(values) - reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def windows(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and anchor of every window, and the prefix sums that hashes of ranges come from."""
    sums = prefix_hashes(values)
    n = len(values)
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), sums
    at = np.arange(n - gram + 1)
    anchors = sliding_least(range_hashes(sums, at, at + gram), length - gram + 1)
    rows = rows_of(offsets)
    starts = np.flatnonzero(rows[:n - length + 1] == rows[length - 1:])
    return starts, rows[starts], anchors[starts] >> ANCHOR_SHIFT, sums


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """True where some column differs from the entry before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _anchor_rows(symbols: Symbols, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            _, rows, anchors, _ = windows(*symbols(*text_bytes(part.column("text"))), length, gram)
            new = run_starts(rows, anchors)
            rows, anchors = rows[new], anchors[new]
            order = np.argsort(anchors, kind="stable")
            rows, anchors = rows[order], anchors[order]
            once = run_starts(rows, anchors)
            rows, anchors = rows[once], anchors[once]
            # Anchors that several documents of this piece have are settled; other pieces only need to hear of them once.
            lead = run_starts(anchors)
            group = np.cumsum(lead) - 1
            shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
            settled = np.flatnonzero(shared)
            at = np.concatenate([np.flatnonzero(lead), settled])
            known = np.zeros(len(at), bool)
            known[len(at) - len(settled):] = True
            # Rows of a document lie together, so that what they have in common is stored once in a shuffle block.
            order = np.argsort(rows[at], kind="stable")
            at, known = at[order], known[order]
            spread = anchors[at].copy()
            spread[known] = mix(spread[known] + rows[at][known].astype(np.uint64)) >> ANCHOR_SHIFT
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(spread)), pa.array(signed(anchors[at]), mask=~known), part.column("doc_id").take(pa.array(rows[at]))],
                ["spread", "settled", "doc_id"])

    return run


def repeated_anchors(texts: DataFrame, symbols: Symbols, length: int, gram: int) -> DataFrame:
    """For each doc_id the list of its anchors that another document has as well.

    A piece of a task sends each anchor once, so an anchor that a third of all documents have is as many rows as there
    are pieces; the documents of that piece get it (`settled`) without a shuffle by the anchor.
    """
    rows = texts.select("doc_id", "text").mapInArrow(_anchor_rows(symbols, length, gram), "spread long, settled long, doc_id long")
    of_anchor = Window.partitionBy("spread")
    repeated = (rows.withColumn("least", F.min("doc_id").over(of_anchor)).withColumn("most", F.max("doc_id").over(of_anchor))
                .where(F.col("settled").isNotNull() | (F.col("least") < F.col("most"))))
    return repeated.groupBy("doc_id").agg(F.collect_list(F.coalesce("settled", "spread")).alias("anchors"))


def packed(texts: DataFrame) -> DataFrame:
    """doc_id, signature and the compressed text, for a shuffle that several joins share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in pieces(batches):
            data, offsets = text_bytes(part.column("text"))
            raw = data.tobytes()
            small = [press.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.array(small, pa.binary())], [*KEY, "packed"])

    return texts.select(*KEY, "text").mapInArrow(run, "doc_id long, signature long, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with a text column (as bytes) in place of the compressed one."""
    expand = zstandard.ZstdDecompressor()
    for part in pieces(batches, "packed", 1 << 18):
        at = part.schema.get_field_index("packed")
        texts = pa.array([expand.decompress(x) for x in part.column(at).to_pylist()], pa.binary())
        yield from pieces(iter([part.set_column(at, "text", texts)]))


def with_marks(texts: DataFrame, copied: DataFrame, marks: DataFrame) -> DataFrame:
    """texts with what marks say of their doc_id, and in `copied` the signatures that are exact copies under this id.

    The same table of texts, joined by the same key, uses the same shuffle each time.
    """
    signatures = copied.groupBy("doc_id").agg(F.collect_set("signature").alias("copied"))
    return texts.join(marks, "doc_id", "left").join(signatures, "doc_id", "left")


def is_copy(part: pa.RecordBatch) -> np.ndarray:
    own = part.column("signature").to_pylist()
    return np.array([c is not None and s in c for s, c in zip(own, part.column("copied").to_pylist(), strict=True)], bool)


def candidates(anchors: np.ndarray, rows: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """True for the windows whose anchor is in the list of their row; rows ascend."""
    out = np.zeros(len(rows), bool)
    bounds = np.searchsorted(rows, np.arange(len(wanted) + 1))
    for k, listed in enumerate(wanted):
        a, b = bounds[k], bounds[k + 1]
        if a < b and len(listed):
            listed = np.sort(listed)
            at = np.minimum(np.searchsorted(listed, anchors[a:b]), len(listed) - 1)
            out[a:b] = listed[at] == anchors[a:b]
    return out


def of_signature(part: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """For each row the structs of its list that bear its signature, as rows of their other integer fields."""
    listed = part.column(column)
    offsets, valid = listed.offsets.to_numpy(), listed.is_valid().to_numpy(zero_copy_only=False)
    fields = [listed.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(listed.type.value_type.num_fields)]
    own = part.column("signature").to_numpy()
    out = []
    for k in range(len(listed)):
        a, b = (offsets[k], offsets[k + 1]) if valid[k] else (0, 0)
        mine = fields[0][a:b] == own[k]
        out.append(np.stack([f[a:b][mine] for f in fields[1:]], axis=1))
    return out


def lists_of(column: pa.Array, kind=np.uint64) -> list[np.ndarray]:
    """Rows of an Arrow list column of integers; a null is an empty list."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(kind)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[offsets[k]:offsets[k + 1]] if valid[k] else values[:0] for k in range(len(column))]
