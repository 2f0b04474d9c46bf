"""Benchmark decontamination with an FM-index per training shard.

1. The test items are cut into phrases: all windows of `length` words, or the whole item if it is shorter. Items are dealt into
   blocks of bounded size; a block's distinct phrases are a small table of word numbers that every task gets.
2. A task cuts its documents into shards of at most SHARD_WORDS words, longer documents in strips that overlap by a phrase, and
   indexes each: suffix order, wavelet ranks of the preceding words, sampled suffix positions.
3. All phrases of the block are searched backwards at once, those found are located, and their spans are merged.

Nothing but the phrases crosses the network. With more than one block, documents with the spans found so far are written and
searched for the next block. Defined cases: a null or empty text has no words and no hits; an item without words has no phrase; a
null item_id hits words but is not counted; rows with one item_id count once; documents with one id are searched each for itself;
a phrase never crosses documents; no items: nothing is hit; an empty table gives no rows; other columns do not matter.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import LOWER, pieces, read_table, rows_of, text_bytes, word_bounds
from rulemill.llm.fm_index import FmIndex
from rulemill.session import materialize

LENGTH = 10
# Words of a shard's index; bytes of test items that a block holds, unless one item alone has more.
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 16 << 20
NOT_A_WORD = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NOT_A_WORD[_a:_b] = False


def words_of(texts: pa.Array, between: np.ndarray = NOT_A_WORD) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of a text column, as bytes, and for each row the number of words before it; between: bytes of no word."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets, between)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = data[~between[data]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(inside)])
    return words, before


class Phrases:
    """The distinct phrases of some items: word numbers, right-aligned, and the items (in string order) that have each."""

    def __init__(self, item_ids: list, texts: list, length: int):
        words, before = words_of(pa.array(texts, pa.large_string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.names = sorted({str(x) for x in item_ids if x is not None}, key=str.encode)
        place = {x: k for k, x in enumerate(self.names)}
        n_words = np.diff(before)
        n_windows = np.where(n_words >= length, n_words - length + 1, np.minimum(n_words, 1))
        item = np.repeat(np.arange(len(n_words)), n_windows)
        start = before[:-1][item] + np.arange(len(item)) - (np.cumsum(n_windows) - n_windows)[item]
        sizes = np.minimum(n_words[item], length)
        rows = np.full((len(item), length), -1, np.int32)
        for k in range(length):
            used = sizes > k
            rows[used, length - 1 - k] = numbers[(start + sizes - 1 - k)[used]]
        distinct, of_row = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.words, self.lengths = distinct, (distinct >= 0).sum(axis=1)
        owner = np.array([place[str(x)] if x is not None else -1 for x in item_ids], np.int64)[item]
        pairs = np.unique(np.stack([of_row.ravel()[owner >= 0], owner[owner >= 0]], axis=1), axis=0)
        self.items = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))

    def items_of(self, phrases: np.ndarray) -> list[str]:
        """The names of the items that have one of the phrases, in string order."""
        return [self.names[k] for k in np.unique(np.concatenate(
            [self.items[:0], *(self.items[self.bounds[p]:self.bounds[p + 1]] for p in phrases.tolist())])).tolist()]


def hits(words: pa.Array, before: np.ndarray, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first words and phrases of all occurrences in the documents of a piece."""
    none = np.empty(0, np.int64)
    if not len(words) or not len(phrases.words):
        return none, none, none
    coded = words.dictionary_encode()
    known = pc.index_in(phrases.vocabulary, value_set=coded.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    numbers = np.where(phrases.words >= 0, np.append(known, 0)[phrases.words], -1)
    possible = np.flatnonzero((numbers != 0).all(axis=1))
    if not len(possible):
        return none, none, none
    numbers, lengths = numbers[possible], phrases.lengths[possible]
    # A separator stands before each document; place[w] is the place of word w among words and separators.
    n_rows = len(before) - 1
    symbols = np.zeros(len(words) + n_rows, np.int64)
    place = np.arange(len(words)) + rows_of(before) + 1
    symbols[place] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    overlap = phrases.words.shape[1] - 1
    found_at, found = [none], [none]
    for first in range(0, max(len(symbols) - overlap, 1), shard_words):
        # Words that neither a phrase nor this shard has need no number of their own in it.
        used, shard = np.unique(np.append(symbols[first:first + shard_words + overlap], 0), return_inverse=True)
        own = np.searchsorted(used, numbers)
        own = np.where((numbers > 0) & (np.append(used, -1)[own] == numbers), own, 0)
        index = FmIndex(shard.ravel()[:-1], len(used))
        low, high = index.search(own, lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = low[phrase] + np.arange(len(phrase)) - (np.cumsum(count) - count)[phrase]
        found_at.append(first + index.locate(rows))
        found.append(possible[phrase])
    at, phrase = np.concatenate(found_at), np.concatenate(found)
    row = np.searchsorted(before + np.arange(n_rows + 1), at, side="right") - 1
    return row, at - row - 1 - before[row], phrase


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def merged(firsts: np.ndarray, lasts: np.ndarray) -> list[tuple[int, int]]:
    """Spans [first, last) with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts.tolist(), lasts.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(shared, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            phrases = shared.value
            words, before = words_of(part.column("text"))
            row, first, phrase = hits(words, before, phrases, shard_words)
            order = np.argsort(row, kind="stable")
            row, first, phrase = row[order], first[order], phrase[order]
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
            for k in np.unique(row).tolist():
                own = slice(bounds[k], bounds[k + 1])
                last = first[own] + phrases.lengths[phrase[own]]
                had = np.array([(x["first"], x["last"]) for x in spans[k]], np.int64).reshape(-1, 2)
                spans[k] = merged(np.concatenate([first[own], had[:, 0]]), np.concatenate([last, had[:, 1]]))
                items[k] = sorted({*items[k], *phrases.items_of(np.unique(phrase[own]))}, key=str.encode)
            spans = [[{"first": x[0], "last": x[1]} if isinstance(x, tuple) else x for x in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(np.diff(before), pa.int64()), pa.array(spans, SPANS),
                 pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    return run


FOUND = "doc_id long, text string, n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def item_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most block_bytes of text; an item that has more is alone with those of its hash."""
    sizes = items.agg(F.sum(F.octet_length("text")).alias("all"), F.max(F.octet_length("text")).alias("one")).first()
    n = max(1, math.ceil((sizes["all"] or 0) / block_bytes))
    while True:
        block = F.pmod(F.xxhash64("text"), F.lit(n))
        most = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= max(block_bytes, sizes["one"] or 0) or n > 1 << 20:
            return [items.where(block == k) for k in range(n)]
        n *= 2


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text, n_words, the merged spans of words (first, last + 1) that items have as well, and the names of those items."""
    spark = docs.sparkSession
    items = items.where(F.col("text").isNotNull()).select("item_id", F.col("text")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.array().cast("array<struct<first: long, last: long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(items, block_bytes)
    for k, block in enumerate(blocks):
        own = block.collect()
        shared = spark.sparkContext.broadcast(Phrases([r["item_id"] for r in own], [r["text"] for r in own], length))
        rows = rows.mapInArrow(_search(shared, shard_words), FOUND)
        if k + 1 < len(blocks):
            rows = materialize(rows, "searched")
    return rows


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
