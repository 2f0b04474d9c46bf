"""The divergence audit against plain counting, with blocks, skybands and chunks small enough to be merged."""
from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from rulemill.llm import source_divergence as sd

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def plain(rows, min_docs=3, top=200):
    """rows of (doc_id, text, lang, source): the result as a set."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = WORD.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // total for t in kept}

        q = shares(whole)
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(items)}
    return out


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def result(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [256, 2])
def test_equals_plain_counts(spark, rows, monkeypatch, block):
    monkeypatch.setattr(sd, "FAN_IN", 2)
    data = [(i, t, ("en", "fr", None)[i % 3], (None, "b", "ß", "a", "")[i * i % 5] if i % 7 else f"rare{i % 4}") for i, t in rows]
    data += [(900, None, "en", "silent"), (901, "...", "xx", "one"), (902, "Az aZ az", "yy", "p"), (902, "az", "yy", "q"), (902, "AZ", "yy", "q")]
    for top in (200, 3):
        assert result(sd.divergence(table(spark, data), top=top, source_block=block)) == plain(data, top=top)


def test_ties_rank_by_bytes(spark):
    data = [(k, "zeta ähre Beta alpha", "en", "s") for k in range(4)] + [(10 + k, "other words", "en", "t") for k in range(4)]
    got = result(sd.divergence(table(spark, data), top=3))
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[:3] == ("en", "s", "term")] == ["alpha", "beta", "zeta"]
    assert got == plain(data, top=3)


def test_long_text_and_hot_source(spark):
    data = [(k, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(k, 40000 + k, 1 + k % 3)), "en", "hot" if k % 3 else "cold")
            for k in range(12)]
    assert result(sd.divergence(table(spark, data))) == plain(data)


def test_empty(spark, empty):
    assert sd.divergence(empty).count() == 0


def test_long_division(spark):
    totals = [(0, 1), (5, 6), (10 ** 12, 10 ** 13 + 7), (3, 10 ** 15 + 1), (10 ** 15, 10 ** 15 + 1)]
    rows = spark.createDataFrame(totals, "n long, total long")
    from pyspark.sql import functions as F
    got = rows.select("n", "total", sd.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == 1 + 10 ** 9 * (r.n + 1) // r.total for r in got)


def test_skyband_holds_the_first_k(spark):
    """Every dropped term has k dominators, and rank positions agree with a full sort."""
    import numpy as np
    r = np.random.default_rng(5)
    points = [("en", "s", f"t{k:05d}", int(a), int(a + b), int(1000 * a), 1) for k, (a, b) in enumerate(r.integers(1, 30, (3000, 2)))]
    known = spark.createDataFrame(points, "lang string, source string, term string, n long, lang_n long, p long, q long").repartition(7)
    band = {x.term for x in sd.skyband(known, 10).collect()}
    for _, _, term, n, lang_n, _, _ in points:
        over = sum(x[3] >= n and x[4] <= lang_n and x[2] < term for x in points)
        assert (term in band) == (over < 10)
