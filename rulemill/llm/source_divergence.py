"""Source divergence audit: how far the words of each source lie from those of its sibling sources and of its language.

1. Tasks count the terms of their documents by (lang, source); sums over tasks give the count of each term in each source. A
   language keeps the terms that enough of its documents have; p is the smoothed share of a term in parts per thousand million.
2. Part `pair`: rows of (term, source, p) are dealt by term into slices, with one header row per source, and a task adds up
   f(p, q) over the terms of its slice for all ordered pairs of sources. Only where one of the two sources has a term does f
   differ from its value for two absent ones, so the work follows the counted rows and not terms times pairs. Languages of more
   than SOURCE_BLOCK sources are dealt by pairs of source blocks, which bounds the sums that a task holds.
3. Part `term`, by dominance: a term cannot rank in the first k of its source if k others have at least its count there, at most
   its count in the language, and come earlier in UTF-8. Every partition keeps its skyband, the terms that fewer than k others
   dominate; skybands merge FAN_IN partitions at a time, and the terms of the last skyband are ranked exactly.

f grows with the source's count and falls with the language's wherever p > q, so a dominating term ranks before the dominated
one and the skyband holds all of the first k. All arithmetic is on integers: shares by long division, so that counts up to 9e15 fit.

Defined cases: null or empty text has no terms, but its group counts as occurring; null lang and source are the empty string; rows
with one doc_id are documents of their own; a language without kept terms gives pairs of value 0 and no term rows; a language of
one source gives no pairs; equal values are ranked by the UTF-8 order of the item; an empty table gives no rows; other columns do
not matter.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulemill.llm.common import pieces, read_table, rows_of
from rulemill.llm.decontamination import words_of
from rulemill.session import broadcast_if_small, materialize

UNIT = 1_000_000_000
MIN_DOCS = 3
TOP = 200
# Bytes of text counted at once; sources in a block; cells of a task's table of shares; terms compared with a skyband at once;
# skybands merged in one task.
COUNT_BYTES = 8 << 20
SOURCE_BLOCK = 256
CELLS = 1 << 21
CHUNK = 1024
FAN_IN = 16
NOT_A_LETTER = np.ones(256, bool)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NOT_A_LETTER[_a:_b] = False

COUNTED = "lang string, source string, term string, n long, n_docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), for a piece of documents at a time."""
    for part in pieces(batches, limit=COUNT_BYTES):
        words, before = words_of(part.column("text"), NOT_A_LETTER)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        n_terms = len(coded.dictionary)
        lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        own, n = np.unique(rows_of(before) * n_terms + coded.indices.to_numpy(), return_counts=True)
        keys, of_own = np.unique(group[own // n_terms] * n_terms + own % n_terms, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, of_own, n)
        group = keys // n_terms
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))),
             coded.dictionary.take(pa.array(keys % n_terms)).cast(pa.binary()).cast(pa.string()),
             pa.array(counts), pa.array(np.bincount(of_own, minlength=len(keys)))],
            ["lang", "source", "term", "n", "n_docs"])


def whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total) by long division, three digits at a time."""
    total = F.greatest(total, F.lit(1).cast("long"))
    quotient, rest = whole(n + 1, total), (n + 1) % total
    for _ in range(3):
        quotient, rest = quotient * 1000 + whole(rest * 1000, total), (rest * 1000) % total
    return quotient + 1


def distance(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), q)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, n_docs documents."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms that a source has (lang, source, term, n, lang_n, p, q) and all sources (lang, source, v kept terms, absent: their share
    of a term they lack)."""
    counts = materialize(term_counts(docs), "term_counts")
    lang_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    lang_terms = materialize(lang_terms.where(F.col("n_docs") >= min_docs).drop("n_docs"), "lang_terms")
    kept = materialize(counts.join(lang_terms, ["lang", "term"]), "kept_terms")
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = lang_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = F.lit(0).cast("long")
    groups = materialize(occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total"))), "sources")
    known = kept.join(broadcast_if_small(groups), ["lang", "source"])
    total, lang_total = F.col("total") + F.col("v"), F.col("lang_total") + F.col("v")
    return (known.select("lang", "source", "term", "n", "lang_n", share(F.col("n"), total).alias("p"), share(F.col("lang_n"), lang_total).alias("q")),
            groups.select("lang", "source", "v", share(zero, total).alias("absent")))


SUMS = "lang string, source string, item string, value long"


class _Sums:
    """Sums of f over the terms of one slice, for the ordered pairs of the sources in one or two blocks."""

    def __init__(self, lang: str, low: int, high: int, headers: list[tuple]):
        self.lang, self.headers = lang, headers
        self.names = [h[0] for h in headers]
        self.place = {name: k for k, name in enumerate(self.names)}
        self.absent = np.array([h[2] for h in headers], np.int64)
        block = np.array([h[1] for h in headers])
        # Pairs within a block are added up where the block meets itself.
        self.wanted = ~np.eye(len(headers), dtype=bool) if low == high else block[:, None] != block[None, :]
        self.total = np.zeros((len(headers), len(headers)), np.int64)
        self.first = headers[0][4] == 0 if headers else False

    def add(self, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
        """Rows of whole terms, in the order of the terms, which are numbered from 0."""
        size = len(self.names)
        step = max(1, CELLS // max(size, 1))
        for low in range(0, int(term[-1]) + 1, step):
            own = slice(*np.searchsorted(term, [low, low + step]))
            t, s, x = term[own] - low, source[own], p[own]
            table = np.tile(self.absent, (int(t[-1]) + 1, 1))
            table[t, s] = x
            by_source = np.argsort(s, kind="stable")
            bounds = np.searchsorted(s[by_source], np.arange(size + 1))
            for k in range(size):
                rows = by_source[bounds[k]:bounds[k + 1]]
                if len(rows):
                    others, here = table[t[rows]], x[rows][:, None]
                    self.total[k] += (distances(here, others) - distances(self.absent[k], others)).sum(axis=0)
                    self.total[:, k] += (distances(self.absent[None, :], here) - distances(self.absent, self.absent[k])[None, :]).sum(axis=0)

    def batch(self) -> pa.RecordBatch:
        """The sums; the first slice adds what two absent terms give, times the number of kept terms."""
        if self.first:
            v = np.array([h[3] for h in self.headers], np.int64)
            self.total += v[:, None] * distances(self.absent[:, None], self.absent[None, :])
        a, b = np.nonzero(self.wanted & (self.first | (self.total != 0)))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(a), pa.string()), pa.array([self.names[k] for k in a], pa.string()),
             pa.array([self.names[k] for k in b], pa.string()), pa.array(self.total[a, b])], ["lang", "source", "item", "value"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang, slice, pair of blocks and term, headers (no term) first; terms may go over the end of a batch."""
    sums, key, headers, held = None, None, [], None

    def flush(rest):
        nonlocal sums
        if sums is None and headers:
            sums = _Sums(key[0], key[2], key[3], headers)
        if sums is not None and rest is not None and rest.num_rows:
            coded = rest.column("term").dictionary_encode().indices.to_numpy()
            source = np.array([sums.place[x] for x in rest.column("source").to_pylist()], np.int64)
            sums.add(coded, source, rest.column("p").to_numpy())

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table, held = pa.concat_tables([held, table]).combine_chunks(), None
        keys = list(zip(*(table.column(c).to_pylist() for c in ("lang", "slice", "low", "high")), strict=True))
        terms = table.column("term").to_pylist()
        first = 0
        while first < len(keys):
            if keys[first] != key:
                if key is not None:
                    flush(None)
                    yield sums.batch()
                sums, key, headers = None, keys[first], []
            last = first
            while last < len(keys) and keys[last] == key and terms[last] is None:
                last += 1
            if last > first:
                part = table.slice(first, last - first)
                headers += list(zip(*(part.column(c).to_pylist() for c in ("source", "block", "p", "v", "slice")), strict=True))
                first = last
                continue
            while last < len(keys) and keys[last] == key:
                last += 1
            if last == len(keys):
                # The last term may go on in the next batch.
                cut = last
                while cut > first and terms[cut - 1] == terms[last - 1]:
                    cut -= 1
                held, last = table.slice(cut), cut
            if last > first:
                flush(table.slice(first, last - first).combine_chunks().to_batches()[0])
            if held is not None:
                break
            first = last
    if key is not None:
        flush(held.combine_chunks().to_batches()[0] if held is not None and held.num_rows else None)
        yield sums.batch()


def pair_values(known: DataFrame, groups: DataFrame, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, item (another source of the lang), value: the sum of f over all kept terms."""
    spark = known.sparkSession
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_blocks = -(-most // source_block) or 1
    n_pairs = n_blocks * (n_blocks + 1) // 2
    n_slices = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // n_pairs)
    block = F.pmod(F.xxhash64("source"), F.lit(n_blocks)).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda k: F.struct(
        F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))).alias("pair")
    # The slice follows the term, so that all sources of a term meet.
    rows = known.select("lang", F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int").alias("slice"), "term", "source", block.alias("block"), "p",
                        F.lit(0).cast("long").alias("v"))
    headers = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), F.lit(None).cast("string").alias("term"),
                            "source", block.alias("block"), F.col("absent").alias("p"), "v")
    dealt = rows.unionByName(headers).select("*", pair).select("lang", "slice", "pair.low", "pair.high", "term", "source", "block", "p", "v")
    sums = dealt.repartition("lang", "slice", "low", "high").sortWithinPartitions("lang", "slice", "low", "high", F.col("term").asc_nulls_first())
    return sums.mapInArrow(_pair_sums, SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


BAND = "lang string, source string, term string, n long, lang_n long, p long, q long, part int"


def _skyband(k: int):
    def keep(n: np.ndarray, lang_n: np.ndarray, band_n: np.ndarray, band_lang_n: np.ndarray) -> np.ndarray:
        """Which of the new terms fewer than k earlier ones dominate; the band comes before all of them."""
        over = ((band_n[None, :] >= n[:, None]) & (band_lang_n[None, :] <= lang_n[:, None])).sum(axis=1)
        inside = (n[None, :] >= n[:, None]) & (lang_n[None, :] <= lang_n[:, None])
        over += np.tril(inside, -1).sum(axis=1)
        return over < k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by lang, source, part and term: what can dominate a term came before it, and nothing later drops it."""
        key, band_n, band_lang_n = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = pa.Table.from_batches([batch]).select(["lang", "source", "part"]).to_pandas()
            bounds = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()).tolist() + [batch.num_rows]
            n, lang_n = batch.column("n").to_numpy(), batch.column("lang_n").to_numpy()
            kept = []
            for first, last in zip(bounds, bounds[1:], strict=False):
                own = tuple(keys.iloc[first])
                if own != key:
                    key, band_n, band_lang_n = own, band_n[:0], band_lang_n[:0]
                for low in range(first, last, CHUNK):
                    part = slice(low, min(low + CHUNK, last))
                    stays = keep(n[part], lang_n[part], band_n, band_lang_n)
                    band_n = np.concatenate([band_n, n[part][stays]])
                    band_lang_n = np.concatenate([band_lang_n, lang_n[part][stays]])
                    kept.append(low + np.flatnonzero(stays))
            if kept:
                yield batch.take(pa.array(np.concatenate(kept)))

    return run


def skyband(known: DataFrame, k: int = TOP) -> DataFrame:
    """The terms with p > q that fewer than k terms of their source dominate, with n, lang_n, p and q."""
    order = ["lang", "source", "part", "term"]
    rows = known.where(F.col("p") > F.col("q")).withColumn("part", F.spark_partition_id())
    band = materialize(rows.sortWithinPartitions(*order).mapInArrow(_skyband(k), BAND), "skyband")
    most = (band.agg(F.max("part")).first()[0] or 0) + 1
    while most > 1:
        band = band.withColumn("part", whole(F.col("part"), F.lit(FAN_IN)).cast("int"))
        band = band.repartition("lang", "source", "part").sortWithinPartitions(*order)
        band = band.mapInArrow(_skyband(k), BAND)
        most = -(-most // FAN_IN)
    return band


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: siblings by distance, and the terms that set a source off most from its language."""
    known, groups = shares(docs, min_docs)
    pairs = pair_values(known, groups, source_block).withColumn("part", F.lit("pair"))
    terms = skyband(known, top).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"),
                                       F.lit("term").alias("part"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(ranked)).select(columns).unionByName(
        terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select(columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))
