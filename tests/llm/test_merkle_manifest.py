"""The manifest against a plain tree, with blocks small enough for several rounds of the exchange."""
from __future__ import annotations

import hashlib
import zlib

import pytest

from rulemill.llm import merkle_manifest as mm


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields) -> str:
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes: list[str], fanout: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain(rows, fanout):
    """rows of (doc_id, source, lang, n_chars, text): sorted result rows."""
    groups: dict = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        groups.setdefault(r[2], []).append((r[0], leaf(*r), leaf(*r[:3], r[3] + 1, r[4]) if changed else leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order], fanout) if order else []
    out = []
    for k, g in enumerate(order):
        for place, (doc_id, own, shown) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            siblings, node = "", shown
            for levels, at in ((trees[g], place), (top, k)):
                for level in levels[:-1]:
                    first = at - at % fanout
                    run = level[first:first + fanout]
                    siblings += "".join(d for j, d in enumerate(run) if first + j != at)
                    node = sha(*(node if first + j == at else d for j, d in enumerate(run)))
                    at //= fanout
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], sha(siblings), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place string, id int, grp string"


def table(spark, rows):
    """Documents with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("fanout,block_levels,n", [(2, 1, 75), (2, 12, 40), (3, 1, 64), (4, 0, 33)])
def test_manifest(spark, fanout, block_levels, n):
    langs = ("en", "en", "en", "de", None, "é")
    rows = [(k * 3, f"s{k % 3}", langs[k % 6], None if k % 11 == 5 else k, ("ß" * k) or None) for k in range(n)]
    rows += [(None, None, None, None, None), (9, "s", "en", 9, "again"), (9, "s", "en", 9, "again"), (1, "", "lone", 1 << 40, "x" * 300_000)]
    got = mm.manifest(mm.document_leaves(table(spark, rows)), fanout, block_levels).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, fanout)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_small_tables(spark):
    assert mm.manifest(mm.document_leaves(table(spark, []))).count() == 0
    one = [(3, "s", "en", 5, "hello")]
    got = [tuple(r) for r in mm.manifest(mm.document_leaves(table(spark, one))).collect()]
    assert got == plain(one, 2) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_a_group_over_many_partitions(spark):
    """One group and repeated rows over range partitions, most of whose blocks lie across a partition's border."""
    rows = [(k // 2, "s", "en", k // 2, "t") for k in range(600)]
    got = mm.manifest(mm.document_leaves(table(spark, rows)), 2, 3).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 2)
