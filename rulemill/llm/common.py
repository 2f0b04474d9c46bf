"""Shared helpers of the corpus operators: reading tables, whole-byte views of Arrow texts, and word hashes.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Texts are handled as UTF-8 bytes, where those six
bytes never occur inside another character, so words found in bytes are the words of the text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are taken apart in pieces of about this many bytes, which bounds the memory of a task; a longer text is a
# piece of its own.
PIECE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow text column and the offsets of its rows in them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return everything[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold about `limit` bytes, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = np.array(values, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; kept for the process."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if n <= 8 * PIECE_BYTES:
            _powers[0] = have
    return have


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums of value[i] * base**i over each prefix, as polynomial hashes modulo 2**64 need them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][:len(values)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of value[start:end], alike for alike ranges wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one entry more than rows).

    between: true for the bytes that are part of no word.
    """
    word = ~between[data]
    n = len(data)
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


PLACES = 64
PLACE_VALUE = _rng.integers(1, 1 << 63, (PLACES, 256), dtype=np.uint64).ravel()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of a random value for each pair of byte and place in the word, so that no pattern of letters collides by its structure."""
    if not len(starts):
        return np.empty(0, np.uint64)
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(starts[0], len(data), dtype=kind) - np.repeat(starts.astype(kind), np.diff(starts, append=len(data)))
    values = PLACE_VALUE[((place & (PLACES - 1)) << 8) | data[starts[0]:]]
    far = np.flatnonzero(place >= PLACES)
    values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(_BASE))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends - starts[0]] - sums[starts - starts[0]])


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each element the row it belongs to, from the offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
