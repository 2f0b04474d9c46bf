"""Substring dedup by Rabin-Karp hashes of word windows.

Every window of WINDOW words gets a hash from prefix sums (a polynomial modulo 2**64 over word hashes, scrambled). Of
all windows, those whose anchor occurs in one document only cannot repeat across documents and are left out before the
shuffle; repeats inside one document are found in its own piece. Spark then finds, for each hash, the first window by
(doc_id, start); the others are repeated, and their union per document gives the maximal removal intervals.

Defined cases: a null or empty text has no words; fewer than WINDOW words have no window; a null id takes no part
(nothing is removed, and it is nobody's earlier window); of rows with one id none is earlier than the other at the same
start; an exact copy of a text with a smaller id loses all its words if it has a window; other columns do not matter.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import mix, range_hashes, read_table, signed, text_bytes, word_bounds, word_hashes
from rulemill.llm.repeats import (
    KEY, candidates, copies, is_copy, keyed, lists_of, of_signature, packed, repeated_anchors, run_starts, unpacked, windows, with_marks,
)
from rulemill.session import materialize

WINDOW = 20
GRAM = 5


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), before


def _window_rows(length: int, gram: int):
    """(spread, doc_id, signature, start, known) of the windows that may be repeated; known ones are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches):
            values, before = word_symbols(*text_bytes(part.column("text")))
            starts, rows, anchors, sums = windows(values, before, length, gram)
            hashes = range_hashes(sums, starts, starts + length)
            ids = part.column("doc_id").fill_null(-1).to_numpy()
            inside = starts - before[rows]
            apart = is_copy(part) | part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            takes_part = ~apart[rows]
            rows, inside, anchors, hashes = rows[takes_part], inside[takes_part], anchors[takes_part], hashes[takes_part]
            # The first of each hash in this piece, by (doc_id, start), may meet earlier ones elsewhere; the rest is repeated.
            order = np.lexsort((inside, ids[rows], hashes))
            hashes, rows, inside, anchors = hashes[order], rows[order], inside[order], anchors[order]
            lead = run_starts(hashes)
            first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(lead) else np.empty(0, np.int64)
            known = (ids[rows] != ids[rows[first]]) | (inside != inside[first])
            wanted = lists_of(part.column("anchors"))
            elsewhere = np.zeros(len(rows), bool)
            by_row = np.argsort(rows, kind="stable")
            elsewhere[by_row] = candidates(anchors[by_row], rows[by_row], wanted)
            sent = np.flatnonzero(known | elsewhere)
            sent = sent[np.lexsort((inside[sent], rows[sent]))]  # neighbours of a document lie together in a shuffle block
            spread, settled = hashes[sent].copy(), known[sent]
            spread[settled] = mix(spread[settled] + inside[sent][settled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                  + rows[sent][settled].astype(np.uint64))
            take = pa.array(rows[sent])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(spread)), part.column("doc_id").take(take), part.column("signature").take(take),
                 pa.array(inside[sent].astype(np.int32)), pa.array(settled)],
                ["spread", *KEY, "start", "known"])

    return run


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """True for the elements of 0..n-1 that a window at one of the starts covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0


def repeated_windows(texts: DataFrame, small: DataFrame, copied: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each doc_id the signatures and starts of its repeated windows."""
    alone = texts.where(F.col("doc_id").isNotNull()).join(copied, KEY, "left_anti")
    anchors = repeated_anchors(alone, word_symbols, length, gram)
    found = with_marks(small, copied, anchors).mapInArrow(
        _window_rows(length, gram), "spread long, doc_id long, signature long, start int, known boolean")
    place = F.struct("doc_id", "start")
    repeated = (found.withColumn("first", F.min(place).over(Window.partitionBy("spread")))
                .where(F.col("known") | (place > F.col("first"))))
    return repeated.groupBy("doc_id").agg(F.collect_list(F.struct("signature", "start")).alias("removed"))


def _kept_words(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches):
            data, offsets = text_bytes(part.column("text"))
            starts, whole = of_signature(part, "removed"), is_copy(part)
            n_words, n_removed, digests = [], [], []
            for k in range(part.num_rows):
                words = data[offsets[k]:offsets[k + 1]].tobytes().split()
                n = len(words)
                if whole[k] and n >= length:
                    words = []
                elif len(starts[k]):
                    words = list(compress(words, (~covered(starts[k][:, 0], n, length)).tolist()))
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    texts = keyed(docs)
    small, copied = packed(texts), materialize(copies(texts), "copies")
    marked = with_marks(small, copied, repeated_windows(texts, small, copied, length, gram))
    return marked.select("doc_id", "signature", "packed", "removed", "copied").mapInArrow(
        _kept_words(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
