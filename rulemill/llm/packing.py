"""Packing by minimum bin slack.

1. One pass turns each whole text into token ids and cuts them into full windows and one rest, with a checksum each.
2. The rests are counted by length: a histogram of at most `capacity` rows, whatever the size of the corpus.
3. The driver plans windows over that histogram. A window starts with the largest length left; a bitset dynamic
   program over the other lengths and their counts finds the largest sum that still fits, and is traced back to counts.
   A window found is used as often as the counts allow, so each step uses up a length for good and there are at most
   as many kinds of windows as there are lengths.
4. Each rest gets its rank among the rests of its length (a prefix sum over salted counts, then a row number in a salted
   slice, so that no task holds a length) and looks its window and offset up in the plan.

Texts are tokenised word by word: the tokenizer's patterns never cross white space, so each distinct word of a piece is
encoded once; a process keeps what it has encoded, up to a bound. Defined cases: a null or empty text is the one end token; documents with the same id are packed each for
itself; other columns are ignored; an empty table gives no rows; ties of length are broken by doc_id and checksum, so the
result does not depend on partitions; a text of any length is cut into as many windows as it fills.
"""
from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import IS_SPACE, pieces, read_table, text_bytes, word_bounds, word_hashes
from rulemill.session import materialize

CAPACITY = 4096
END_TOKEN = 2
TOKENIZER = "word_bpe_49k.json"
# Words kept encoded in a process, about 30 bytes each; beyond it the store starts anew. Words encoded in one call.
KNOWN_WORDS = 2_500_000
WORDS_AT_ONCE = 20_000


class WordEncoder:
    """Ids of whole texts, from ids of distinct words; a process keeps the words it has met, up to a bound."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), known_words
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes, and for each the place and number of its ids.
        self.hashes = np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int64)
        self.count = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint16)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """hashes ascend, and none is known yet."""
        for first in range(0, len(words), WORDS_AT_ONCE):
            some, own = words[first:first + WORDS_AT_ONCE], hashes[first:first + WORDS_AT_ONCE]
            found = self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0]
            ids, of_word = found.ids, found.word_ids
            if None in of_word:  # special tokens inside a text belong to no word
                single = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                ids, of_word = [i for x in single for i in x], [k for k, x in enumerate(single) for _ in x]
            count = np.bincount(np.array(of_word, np.int64), minlength=len(some)).astype(np.int32)
            begin = np.cumsum(count, dtype=np.int64) - count + len(self.ids)
            self.ids = np.concatenate([self.ids, np.array(ids, np.uint16)])
            at = np.searchsorted(self.hashes, own)
            self.hashes = np.insert(self.hashes, at, own)
            self.begin = np.insert(self.begin, at, begin)
            self.count = np.insert(self.count, at, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end token behind each row's, and the rows' offsets in them."""
        starts, ends, words_before = word_bounds(data, offsets)
        # Words of these texts are told apart by their bytes; the store finds them by hash.
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~IS_SPACE[data]])])
        coded = words.dictionary_encode()
        letters, bounds = text_bytes(coded.dictionary)
        distinct, first, of_hash = np.unique(word_hashes(letters, bounds[:-1], bounds[1:]), return_index=True, return_inverse=True)
        of_word = of_hash.ravel()[coded.indices.to_numpy()]
        new = self._unknown(distinct)
        if len(new) and len(self.hashes) + len(new) > self.bound:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            self._learn([word.decode() for word in coded.dictionary.take(pa.array(first[new])).to_pylist()], distinct[new])
        number = np.searchsorted(self.hashes, distinct)[of_word]
        begin, count = self.begin[number], self.count[number].astype(np.int64)
        # Where each word's ids go: behind those of the words before it, and one end token per row before its own.
        before = np.concatenate([[0], np.cumsum(count)])
        row_ids = before[words_before] + np.arange(len(offsets))
        n_rows = len(offsets) - 1
        rows = np.repeat(np.arange(n_rows), np.diff(words_before))
        out = np.full(int(row_ids[-1]), END_TOKEN, np.uint32)
        total = int(before[-1])
        if total:
            shift = np.arange(total) - np.repeat(before[:-1], count)
            out[np.arange(total) + np.repeat(rows, count)] = self.ids[np.repeat(begin, count) + shift]
        return out, row_ids

    def _unknown(self, distinct: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        return np.flatnonzero(~known)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Full windows and the rest of each document, with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for part in pieces(batches):
            ids, offsets = encoder.encode(*text_bytes(part.column("text")))
            out: list[list[int]] = [[] for _ in range(5)]
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                raw = ids[a:b].astype("<u4").tobytes()
                for start in range(0, b - a, capacity):
                    end = min(start + capacity, b - a)
                    for column, value in zip(out, (doc_id, start, end - start, zlib.crc32(raw[4 * start:4 * end]), b - a), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], PIECES_SCHEMA.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_SCHEMA)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of the lengths, within their counts, whose sum is the largest that `room` holds.

    Bit s of a set means that s can be reached; lengths go from the largest down, counts by doubling, and the search
    ends as soon as the room can be filled.
    """
    lengths = sorted((x for x in counts if 0 < x <= room and counts[x]), reverse=True)
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for x in lengths:
        left = min(counts[x], room // x)
        take = 1
        while left > 0:
            n = min(take, left)
            steps.append((reached, x, n))
            reached |= reached << (n * x) & mask
            left -= n
            take *= 2
        if reached >> room & 1:
            break
    s = reached.bit_length() - 1
    out: dict[int, int] = {}
    for before, x, n in reversed(steps):
        if not before >> s & 1:
            s -= n * x
            out[x] = out.get(x, 0) + n
    return out


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths and their counts, times) until every rest has a window."""
    left = {x: n for x, n in counts.items() if n}
    plan = []
    while left:
        seed = max(left)
        others = dict(left)
        others[seed] -= 1
        window = fullest(others, capacity - seed)
        window[seed] = window.get(seed, 0) + 1
        times = min(left[x] // n for x, n in window.items())
        plan.append((window, times))
        for x, n in window.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: ranks from `rank` on, of `length`, go `per` to a sequence from `sequence` on, behind `offset`."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for window, times in plan:
        offset = 0
        for x in sorted(window, reverse=True):
            rows.append((x, used.get(x, 0), first, window[x], offset))
            used[x] = used.get(x, 0) + times * window[x]
            offset += x * window[x]
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "per", "offset"), table.T, strict=True))


PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    spark = docs.sparkSession
    slices = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(token_pieces(docs, tokenizer_path, capacity), "token-pieces")
    salted = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)))
    counts = salted.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Full windows are sequences of their own, in the order of their rank.
    full = histogram.pop(capacity, 0)
    plan = places([({capacity: 1}, full)] * bool(full) + plan_windows(histogram, capacity))

    by_length = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "slice", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = (salted.withColumn("in_slice", F.row_number().over(in_slice) - 1)
              .join(before, ["length", "slice"])
              .withColumn("rank", F.col("in_slice") + F.col("before")))
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        wide = np.int64(1) << np.int64(48)
        keys = p["length"] * wide + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            step = rank - p["rank"][at]
            sequence = p["sequence"][at] + step // p["per"][at]
            offset = p["offset"][at] + step % p["per"][at] * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)],
                batch.schema.names[:5] + ["sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(run, PACKED_SCHEMA)


def _tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), _tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: one row per piece of a sequence."""
    return pack(docs, _tokenizer_path())
