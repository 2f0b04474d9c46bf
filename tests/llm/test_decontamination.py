"""Decontamination against a plain search, with shards and item blocks small enough that matches lie across their ends."""
from __future__ import annotations

import random
import re

import pytest

from rulemill.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(rows, items, length):
    """doc rows in order: (doc_id, number of words, hit words, names)."""
    phrases = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(len(w) - length, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[i:i + length]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, names = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in phrases:
                    hit |= set(range(i, i + size))
                    names |= phrases[tuple(w[i:i + size])]
        out.append((doc_id, len(w), len(hit), ",".join(sorted((str(x) for x in names if x is not None), key=str.encode))))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), ",".join(r["items"])) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def both(rows):
    r = random.Random(4)
    long = [t for _, t in rows if len(words(t)) > 12]
    items = [(k, " ".join(words(r.choice(long))[r.randrange(5):][:r.randrange(1, 25)])) for k in range(40)]
    items += [(7, "one two"), (7, "one two"), (100, "One-TWO!"), (None, "one"), (101, None), (102, ""), (103, "..."), (104, "never seen in any text"),
              (105, "a b " * 400)]
    data = [*rows, (None, "x one two y"), (3, "ONE, two; one two"), (500, "a b " * 1000), (501, "a a b b " * 50), (502, "one"), (503, "two")]
    return data, items


@pytest.mark.parametrize("length, shard, block", [(10, 1 << 19, 1 << 24), (4, 500, 4000)])
def test_equals_plain_search(spark, both, length, shard, block):
    data, items = both
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, spans string, n_words int").repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert result(dc.contamination(docs, bench, length, block, shard)) == plain(data, items, length)


def test_empty(spark, empty, both):
    bench = spark.createDataFrame(both[1], "item_id long, text string")
    assert dc.contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(both[0], "doc_id long, text string")
    assert result(dc.contamination(docs, none)) == plain(both[0], [], 10)
