"""Suffix-array dedup of byte strings: what a document shares, over LENGTH bytes or more, with one of a smaller id goes.

1. Anchors (see repeats) leave the stretches whose strings may occur in two documents.
2. Each shard, a piece of a task, builds the suffix array of its stretches by Larsson-Sadakane refinement and takes the
   common prefixes of neighbours by Kasai's rule. Neighbours that share LENGTH bytes form a group; in all but its
   smallest document the string is removed.
3. What is left of a shard, the first occurrences, is sent as short stretches under their anchor. Where the stretches of
   all shards meet, their strings are merged in sorted order: each block looks its strings up among those of smaller
   documents by binary search. Strings of an anchor with very many windows (hot, as a sample of the documents tells) go
   one by one under a hash of their own instead, so no task holds all strings of such an anchor; which anchors count as
   hot changes the load, not the result.
4. The removed strings of a document are united into maximal spans.

Defined cases: a null or empty text has no bytes; fewer than LENGTH bytes have no string; a null id takes no part
(nothing is removed, and it makes nothing removed elsewhere); rows with one id remove nothing from each other; an exact
copy of a text with a smaller id loses all its bytes if it has a string; other columns do not matter. Removal may cut
through a character; kept bytes are hashed as bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm.common import BYTE_VALUE, mix, pieces, range_hashes, read_table, signed, text_bytes
from rulemill.llm.repeats import (
    KEY, candidates, copies, is_copy, keyed, lists_of, packed, repeated_anchors, run_starts, unpacked, windows, with_marks,
)
from rulemill.llm.suffix_array import common_prefixes, suffix_order
from rulemill.session import materialize

LENGTH = 50
GRAM = 16
# Strings merged at once where the stretches of an anchor meet.
BLOCK_BYTES = 1 << 20
# An anchor is hot from so many windows on, as estimated from one document in SAMPLED and all those over LARGE bytes.
HOT_WINDOWS = 1 << 17
SAMPLED = 16
LARGE = 1 << 20


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUE[data], offsets


def stretches(starts: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each maximal run of strings that touch, in one row; starts ascend."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] - starts[:-1] > length) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last]


def shard_groups(data: np.ndarray, starts: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): indexes into starts, ordered by their strings, and a number for each distinct string."""
    a, b = stretches(starts, rows, length)
    size = b + length - a
    into = np.cumsum(size) - size
    text = data[np.arange(int(size.sum())) + np.repeat(a - into, size)]
    which = np.searchsorted(a, starts, side="right") - 1
    inside = starts - a[which] + into[which]
    suffixes, _ = suffix_order(text, inside, length)
    number = np.zeros(len(text), np.int64)
    number[inside] = np.arange(len(inside))
    return number[suffixes], np.cumsum(common_prefixes(text, suffixes, length) < length)


def _intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First start and end of each maximal union of the strings at ascending starts."""
    first, last = stretches(starts, np.zeros(len(starts), np.int64), length)
    return first, last + length


# A place is one number: the start of a span (30 bits), its length (13 bits) and 20 bits of the signature of its text,
# which tell rows with one id but different texts apart. Longer spans are cut. A text beyond START_BITS is an error.
START_BITS, LENGTH_BITS, MARK_BITS = 30, 13, 20
LONGEST = 4096
_SENT = "spread long, doc_id long, place long, stretch binary"


def _marks(part: pa.RecordBatch) -> np.ndarray:
    return part.column("signature").to_numpy() & ((1 << MARK_BITS) - 1)


def _placed(starts: np.ndarray, stops: np.ndarray, marks: np.ndarray) -> np.ndarray:
    if len(starts) and int(starts.max()) >> START_BITS:
        raise ValueError(f"a text has {1 << START_BITS} bytes or more")
    return (starts.astype(np.int64) << LENGTH_BITS | (stops - starts).astype(np.int64)) << MARK_BITS | marks


def _spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = places >> MARK_BITS
    start = both >> LENGTH_BITS
    return start, start + (both & ((1 << LENGTH_BITS) - 1))


def _cut(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans in parts of at most LONGEST."""
    n = -(-(stops - starts) // LONGEST)
    begin = np.repeat(starts, n) + LONGEST * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(begin + LONGEST, np.repeat(stops, n))


def _window_counts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            _, rows, anchors, _ = windows(*byte_symbols(*text_bytes(part.column("text"))), length, gram)
            distinct, at = np.unique(anchors, return_inverse=True)
            n = np.bincount(at, part.column("weight").to_numpy()[rows], len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(distinct)), pa.array(n)], ["anchor", "n"])

    return run


def hot_anchors(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Sorted anchors of HOT_WINDOWS windows or more, by estimate: at most one in HOT_WINDOWS of all windows."""
    large = F.octet_length("text") > LARGE
    sample = texts.where(large | (F.pmod(F.xxhash64(*KEY), F.lit(SAMPLED)) == 0)).select(
        "text", F.when(large, 1).otherwise(SAMPLED).cast("long").alias("weight"))
    counts = sample.mapInArrow(_window_counts(length, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= HOT_WINDOWS).select("anchor").toArrow().column("anchor").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _shard_rows(length: int, gram: int, hot: np.ndarray):
    """Spans that are settled in the shard (without a stretch), and the stretches of first occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (x.filter(x.column("anchors").is_valid()) for x in batches)
        for part in unpacked(known):
            data, offsets = text_bytes(part.column("text"))
            starts, rows, anchors, sums = windows(*byte_symbols(data, offsets), length, gram)
            here = candidates(anchors, rows, lists_of(part.column("anchors")))
            starts, rows, anchors = starts[here], rows[here], anchors[here]
            if not len(starts):
                continue
            ids = part.column("doc_id").to_numpy()
            order, group = shard_groups(data, starts, rows, length)
            least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[rows[order]])
            removed = np.zeros(len(starts), bool)
            removed[order] = ids[rows[order]] > least[group]
            marks = _marks(part)
            spread, doc_row, place, text = [], [], [], []

            gone = np.flatnonzero(removed)
            lead = run_starts(rows[gone]) if len(gone) else np.zeros(0, bool)
            for k, at in enumerate(np.split(gone, np.flatnonzero(lead)[1:])):
                if len(at):
                    row = int(rows[at[0]])
                    a, b = _cut(*_intervals(starts[at] - offsets[row], length))
                    spread.append(mix(a.astype(np.uint64) + np.uint64(row << 32)))
                    doc_row.append(np.full(len(a), row))
                    place.append(_placed(a, b, marks[row]))
                    text += [None] * len(a)
            left = np.flatnonzero(~removed)
            if len(left):
                s, r, m = starts[left], rows[left], anchors[left]
                if len(hot):
                    alone = hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m
                    m = np.where(alone, range_hashes(sums, s, s + length), m)
                new = run_starts(r, m)
                new[1:] |= s[1:] != s[:-1] + 1
                new[(np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))) % LONGEST == 0] = True
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(s)) - 1
                spread.append(m[first])
                doc_row.append(r[first])
                place.append(_placed(s[first] - offsets[r[first]], s[last] + length - offsets[r[first]], marks[r[first]]))
                raw = data.tobytes()
                text += [raw[x:y] for x, y in zip(s[first].tolist(), (s[last] + length).tolist(), strict=True)]
            if doc_row:
                take = pa.array(np.concatenate(doc_row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(spread))), part.column("doc_id").take(take), pa.array(np.concatenate(place)),
                     pa.array(text, pa.binary())],
                    ["spread", "doc_id", "place", "stretch"])

    return run


def _strings(stretch: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the stretches, with a mark behind each so that trailing zero bytes count; their rows and places."""
    data, offsets = text_bytes(stretch)
    padded = np.append(data, np.zeros(length, np.uint8))
    n = np.diff(offsets) - length + 1
    rows = np.repeat(np.arange(len(n)), n)
    places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    table = np.empty((len(rows), length + 1), np.uint8)
    table[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[offsets[rows] + places]
    table[:, length] = 1
    return table.view(f"S{length + 1}").ravel(), rows, places


class _Merger:
    """Strings of one anchor met so far, sorted, with their smallest document."""

    def __init__(self, length: int):
        self.length, self.anchor = length, None
        self.strings = np.empty(0, f"S{length + 1}")
        self.least = np.empty(0, np.int64)

    def block(self, part: pa.RecordBatch) -> pa.RecordBatch | None:
        """Spans of the block that a smaller document has; rows ascend by anchor and document, from block to block."""
        anchors, ids = part.column("spread").to_numpy(), part.column("doc_id").to_numpy()
        strings, rows, places = _strings(part.column("stretch"), self.length)
        order = np.argsort(strings, kind="stable")  # equal strings stay in the order of their documents
        ordered = strings[order]
        lead = run_starts(ordered)
        group = np.cumsum(lead) - 1
        distinct, least = ordered[lead], ids[rows[order[lead]]]
        if self.anchor == anchors[0] and len(self.strings):
            at = np.minimum(np.searchsorted(self.strings, distinct), len(self.strings) - 1)
            met = self.strings[at] == distinct
            least = np.where(met, np.minimum(least, self.least[at]), least)
        gone = order[ids[rows[order]] > least[group]]
        # Only the last anchor can go on in the next block.
        on = anchors[rows[order[lead]]] == anchors[-1]
        if self.anchor == anchors[-1]:
            together = np.concatenate([self.strings, distinct[on]])
            smallest = np.concatenate([self.least, least[on]])
            by_string = np.lexsort((smallest, np.argsort(np.argsort(together, kind="stable"), kind="stable")))
            together, smallest = together[by_string], smallest[by_string]
            once = run_starts(together)
            self.strings, self.least = together[once], np.minimum.reduceat(smallest, np.flatnonzero(once))
        else:
            self.anchor, self.strings, self.least = anchors[-1], distinct[on], least[on]
        if not len(gone):
            return None
        gone.sort()
        rows, places = rows[gone], places[gone]
        new = run_starts(rows)
        new[1:] |= places[1:] != places[:-1] + 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        sent = part.column("place").to_numpy()[rows[first]]
        base, marks = _spans(sent)[0], sent & ((1 << MARK_BITS) - 1)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(rows[first])),
             pa.array(_placed(base + places[first], base + places[last] + self.length, marks))],
            ["doc_id", "place"])


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _Merger(length)
        for part in pieces(batches, "stretch", BLOCK_BYTES):
            settled = part.filter(part.column("stretch").is_null())
            if settled.num_rows:
                yield settled.select(["doc_id", "place"])
            open_rows = part.filter(part.column("stretch").is_valid())
            if open_rows.num_rows:
                found = merger.block(open_rows)
                if found is not None:
                    yield found

    return run


def sent_rows(texts: DataFrame, small: DataFrame, copied: DataFrame, length: int, gram: int) -> DataFrame:
    """What the shards send: settled spans, and stretches under the key where equal strings meet."""
    alone = texts.where(F.col("doc_id").isNotNull()).join(copied, KEY, "left_anti")
    anchors = repeated_anchors(alone, byte_symbols, length, gram)
    hot = hot_anchors(texts.where(F.col("doc_id").isNotNull()), length, gram)
    return with_marks(small, copied, anchors).select(*KEY, "packed", "anchors").mapInArrow(_shard_rows(length, gram, hot), _SENT)


def removed_spans(texts: DataFrame, small: DataFrame, copied: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each doc_id the places of its removed spans, which may touch or overlap."""
    sent = sent_rows(texts, small, copied, length, gram)
    spans = (sent.repartition("spread").sortWithinPartitions("spread", "doc_id")
             .mapInArrow(_merged(length), "doc_id long, place long"))
    return spans.groupBy("doc_id").agg(F.collect_list("place").alias("removed"))


def _kept_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(batches):
            data, offsets = text_bytes(part.column("text"))
            found, marks, whole = lists_of(part.column("removed"), np.int64), _marks(part), is_copy(part)
            sizes, removed, n_spans, digests = np.diff(offsets), [], [], []
            for k, n in enumerate(sizes.tolist()):
                text = data[offsets[k]:offsets[k + 1]]
                if whole[k] and n >= length:
                    text, gone, spans = text[:0], n, 1
                elif len(found[k]):
                    start, stop = _spans(found[k][found[k] & ((1 << MARK_BITS) - 1) == marks[k]])
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, stop, -1)
                    cut = np.cumsum(change[:n]) > 0
                    spans = int(cut[:1].sum()) + int((cut[1:] & ~cut[:-1]).sum())
                    text, gone = text[~cut], int(cut.sum())
                else:
                    gone, spans = 0, 0
                removed.append(gone)
                n_spans.append(spans)
                digests.append(hashlib.sha256(text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_shared_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    texts = keyed(docs)
    small, copied = packed(texts), materialize(copies(texts), "copies")
    marked = with_marks(small, copied, removed_spans(texts, small, copied, length, gram))
    return marked.select("doc_id", "signature", "packed", "removed", "copied").mapInArrow(
        _kept_bytes(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_bytes(read_table(spark, sf_dir, "documents"))
