"""Secret scans: all rules are one automaton, which reads every byte of every text once.

The automaton joins the leads of all rules (what every match that is kept begins with; whole rules would multiply their
length counters) and tells which rules have a lead in a segment. A segment is a stretch between bytes that no match of
any rule holds (such as line ends), so no match crosses one, and many segments are read side by side: step t moves all
segments that are longer than t by one lookup in the transition array. A long segment is cut into strips that are read
side by side as well; strips that the one before ends in another state than they were begun in are read again from there.
Only segments with a lead are read again, by the automata of that rule: one from right to left marks where matches begin,
so no start is tried in vain, and one from left to right gives the exact spans: leftmost, longest, without overlaps inside
one kind; a match below the rule's least length is dropped but still uses up its bytes. The time is linear in the text,
since a match of these rules is read at most one byte beyond its end. What a rule has beyond a segment (the lines of a
private key) is read on from the end of its match, in the bytes of the row.

Texts are UTF-8 bytes; offsets are given in code points, end exclusive. Defined cases: a null or empty text has no
spans; documents with the same id are scanned each for itself; ties do not arise, as a kind never has two spans with
one start; spans with one start are ordered as the kinds are listed; a very long text, in one line or many, takes time in
proportion to its length. `redact` keeps every column of its input and puts
`[kind]` in place of each stretch of overlapping spans (the kind of its first span); n_chars, where it is a column,
becomes the new length. Memory is bounded by the bytes of one piece of a batch.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rulemill.llm.automaton import Automaton, compile_patterns
from rulemill.llm.common import pieces, read_table, text_bytes

PIECE = 4 << 20
# Longer segments are read as strips of this many bytes.
STRIP = 2048
# So few strips are read one after the other, which is faster than an array step per byte.
FEW = 32


@dataclass(frozen=True)
class SecretRule:
    """`found` is what a match is; `kept` are the matches that are long enough, each of which begins with a `lead`.

    `rests` are regular expressions for what follows a match and belongs to its span; the first that matches counts.
    """
    kind: str
    lead: str
    found: str
    kept: str
    rests: tuple[bytes, ...] = ()


# The base kinds, in the order they are listed.
_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE = (
    SecretRule("assign", _KEY, _KEY + "+", _KEY + "{6,}"),
    SecretRule("access", "AKIA[A-Z0-9]{4}", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", "[0-9a-f]{24}", "[0-9a-f]+", "[0-9a-f]{24,}"),
)


def _same(kind: str, lead: str, pattern: str) -> SecretRule:
    return SecretRule(kind, lead, pattern, pattern)


# What follows the first line of a private key: all up to its END line, if no other such line comes before. Without END: header
# fields, then lines of base64 between line ends (also written as escapes), quotes and signs of comments, and a last shorter
# one that has its line to itself or ends the text. Nothing is tried twice, so the time is linear.
_BREAK = rb"""(?:\\[rnt]|[\s"'\\,;>#*|+])"""
_PEM = (
    rb"(?s:(?!-----).)*+-----END [A-Z ]*+(?:(?<=PRIVATE KEY)|(?<=PRIVATE KEY BLOCK))-----",
    rb"(?:" + _BREAK + rb"*+[A-Za-z][A-Za-z0-9-]*+:[ \t]*+(?:(?!\\[rn])\S)++)*+(?:(?:" + _BREAK + rb"*+[A-Za-z0-9+/=]{16,}+)++(?:" + _BREAK
    + rb"""*+[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n"']|\\[rn]|\Z)))?+|""" + _BREAK + rb"*+[A-Za-z0-9+/=]++\Z)?+",
)

# Published forms of keys with a prefix of their own.
MORE = (
    SecretRule("private_key", "-----BEGIN ", *[r"-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?-----"] * 2, _PEM),
    _same("jwt", "eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    _same("forge_token", "gh[oprsu]_[A-Za-z0-9]", r"gh[oprsu]_[A-Za-z0-9]{20,}"),
    _same("chat_token", "xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    _same("live_key", "[ps]k_live_", r"[ps]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


class _Matcher:
    """Finds the matches of one rule in a segment by three automata."""

    def __init__(self, rule: SecretRule):
        found = compile_patterns([rule.found], anywhere=False)
        self.outside = found.never()
        self.found, self.dead = found.lists, found.dead()
        self.begins = compile_patterns([rule.found], anywhere=True, backwards=True).lists
        self.kept = compile_patterns([rule.kept], anywhere=False).lists

    def scan(self, segment: bytes) -> list[tuple[int, int]]:
        """Leftmost longest matches, without overlaps, that are kept."""
        moves, accepts = self.begins
        state, starts = 0, []
        for i in range(len(segment) - 1, -1, -1):
            state = moves[state][segment[i]]
            if accepts[state]:
                starts.append(i)
        moves, accepts = self.found
        kept_moves, kept_accepts = self.kept
        out, done, n, dead = [], 0, len(segment), self.dead
        for i in reversed(starts):
            if i < done:
                continue
            state = 0
            for j in range(i, n):
                state = moves[state][segment[j]]
                if state == dead:
                    break
                if accepts[state]:
                    done = j + 1
            state = 0
            for byte in segment[i:done]:
                state = kept_moves[state][byte]
            if kept_accepts[state]:
                out.append((i, done))
        return out


@lru_cache(maxsize=4)
def _compiled(rules: tuple[SecretRule, ...]) -> tuple[Automaton, np.ndarray, list[_Matcher]]:
    """The combined automaton, the bytes that no match holds, and a matcher for each rule. Built once in a process."""
    single = [_Matcher(r) for r in rules]
    outside = np.logical_and.reduce([m.outside for m in single])
    return compile_patterns([r.lead for r in rules], anywhere=True), outside, single


def _segments(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of bytes that a match may hold; none crosses a row."""
    inside = ~outside[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1 - starts


def _read(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray,
          automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The state (times 256) after each strip, begun in the given one, and the rules that accept on the way.

    Step t moves all strips.
    """
    if len(starts) <= FEW:
        moves, accepts = automaton.lists
        ends, of_strip = state.copy(), np.zeros(len(starts), np.int64)
        for i, (a, n, s) in enumerate(zip(starts.tolist(), lengths.tolist(), state.tolist(), strict=True)):
            s, seen = s >> 8, 0
            for byte in data[a:a + n].tobytes():
                s = moves[s][byte]
                seen |= accepts[s]
            ends[i], of_strip[i] = s << 8, seen
        return ends, of_strip
    by_length = np.argsort(-lengths, kind="stable")
    place, lengths, state = starts[by_length], lengths[by_length], state[by_length]
    table, accepting = automaton.moves.ravel() * 256, automaton.accepts != 0
    bits = np.zeros(len(place), np.int64)
    alive = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # strips longer than t
    for n in alive.tolist():
        now = table[state[:n] + data[place[:n]]]
        state[:n] = now
        place[:n] += 1
        ended = np.flatnonzero(accepting[now >> 8])
        if len(ended):
            bits[ended] |= automaton.accepts[now[ended] >> 8]
    ends, of_strip = np.empty_like(state), np.empty_like(bits)
    ends[by_length], of_strip[by_length] = state, bits
    return ends, of_strip


def hits(data: np.ndarray, offsets: np.ndarray, automaton: Automaton, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rule bits of the segments in which some rule has a lead."""
    starts, lengths = _segments(data, offsets, outside)
    long_enough = lengths >= automaton.shortest()
    starts, lengths = starts[long_enough], lengths[long_enough]
    strips = -(-lengths // STRIP)
    segment = np.repeat(np.arange(len(starts)), strips)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(strips) - strips, strips)
    begin = starts[segment] + nth * STRIP
    size = np.minimum(lengths[segment] - nth * STRIP, STRIP)
    assumed = np.zeros(len(segment), np.int32)
    ends, found = _read(data, begin, size, assumed, automaton)
    again = np.flatnonzero(nth > 0)
    while len(again := again[ends[again - 1] != assumed[again]]):
        assumed[again] = ends[again - 1]
        ends[again], more = _read(data, begin[again], size[again], assumed[again], automaton)
        found[again] |= more
        again = again[again + 1 < len(nth)] + 1
        again = again[nth[again] > 0]
    bits = np.zeros(len(starts), np.int64)
    np.bitwise_or.at(bits, segment, found)
    some = bits != 0
    return starts[some], lengths[some], bits[some]


def _with_rest(text: bytes, end: int, rests: tuple[bytes, ...]) -> int:
    """The end of a match together with what follows it."""
    return next((m.end() for m in (re.compile(r).match(text, end) for r in rests) if m), end)


def spans(data: np.ndarray, offsets: np.ndarray, rules: tuple[SecretRule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """For rows with a match: (start, rule, end) in bytes of the row, ordered."""
    combined, outside, single = _compiled(rules)
    out: dict[int, list[tuple[int, int, int]]] = {}
    text, text_row = b"", -1
    for start, length, bits in zip(*(x.tolist() for x in hits(data, offsets, combined, outside)), strict=True):
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        segment = data[start:start + length].tobytes()
        shift = start - int(offsets[row])
        for k in range(len(rules)):
            if bits >> k & 1:
                found = [(shift + a, k, shift + b) for a, b in single[k].scan(segment)]
                if found and rules[k].rests:
                    if row != text_row:
                        text, text_row = data[offsets[row]:offsets[row + 1]].tobytes(), row
                    found = [(a, k, _with_rest(text, b, rules[k].rests)) for a, k, b in found]
                out.setdefault(row, []).extend(found)
    return {row: sorted(found) for row, found in out.items()}


def _code_points(text: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte, and at the end."""
    out = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text & 0xC0) != 0x80, out=out[1:])
    return out


def _written(found: list[tuple[int, int, int]], rules: tuple[SecretRule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for part in pieces(batches, "text", PIECE):
        data, offsets = text_bytes(part.column("text"))
        n = part.num_rows
        counts = [[0] * n for _ in BASE]
        digests, lists = [nothing] * n, [""] * n
        for row, found in spans(data, offsets).items():
            points = _code_points(data[offsets[row]:offsets[row + 1]])
            found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
            base = [x for x in found if x[1] < len(BASE)]
            for _, k, _ in base:
                counts[k][row] += 1
            digests[row] = hashlib.sha256(_written(base, RULES).encode()).hexdigest()
            lists[row] = _written(found, RULES)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
             pa.array(digests, pa.string()), pa.array(lists, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with the counts of the base kinds, their digest and all spans."""
    return docs.select("doc_id", "text").mapInArrow(_report, SCAN_SCHEMA)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with each stretch of spans replaced by its kind in brackets."""
    n_chars = next((f.name for f in docs.schema if f.name == "n_chars"), None)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text, PIECE):
            data, offsets = text_bytes(part.column(text))
            found = spans(data, offsets)
            if not found:
                yield part
                continue
            texts = part.column(text).to_pylist()
            for row, of_row in found.items():
                whole, out, done = data[offsets[row]:offsets[row + 1]].tobytes(), [], 0
                for a, k, b in of_row:
                    if a >= done:
                        out += [whole[done:a], f"[{RULES[k].kind}]".encode()]
                    done = max(done, b)
                texts[row] = b"".join([*out, whole[done:]]).decode()
            new = {text: pa.array(texts, pa.string())}
            if n_chars:
                lengths = part.column(n_chars).to_pylist()
                for row in found:
                    lengths[row] = len(texts[row])
                new[n_chars] = pa.array(lengths, part.column(n_chars).type)
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names)

    return docs.mapInArrow(run, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every document stays, its secrets are replaced."""
    return redact(docs)
