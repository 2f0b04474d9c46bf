"""Each operator against a plain version, and its defined cases."""
from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import merkle_audit, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup
from rulemill.llm.automaton import compile_patterns
from rulemill.llm.graph import components
from rulemill.llm.statistics import COUNTS, with_statistics
from rulemill.llm.suffix_array import common_prefixes, suffix_order
from tests.llm import brute


def test_statistics(docs, rows):
    got = {r.doc_id: tuple(r[f"s_{c}"] for c in COUNTS) for r in with_statistics(docs, prefix="s_").collect()}
    assert got == {i: brute.quality_counts(t) for i, t in rows}


def test_quality_rules(docs, rows, labels, empty):
    rules = quality_rules.learn(docs, labels)
    out = {r.doc_id: r for r in quality_rules.apply(docs.select("doc_id", "text"), rules).collect()}
    for i, text in rows:
        n, _, _, _, repeated = brute.quality_counts(text)
        failed = n < 10 or 100 * repeated > 20 * n
        assert out[i].base_failed == failed and out[i].kept == (not failed and out[i].rule == 0)
    assert rules.rules
    assert all("***" in (t or "") for i, t in rows if out[i].rule)
    assert quality_rules.learn(docs, labels.limit(0)).rules == ()
    assert quality_rules.apply(empty.select("doc_id", "text"), rules).count() == 0


def test_quality_classifier(docs, labels, rows, empty):
    out = quality_classifier.score_documents(docs, labels).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    unseen = [(r.predicted, "***" not in (dict(rows)[r.doc_id] or "")) for r in out if r.held_out]
    assert np.mean([a == b for a, b in unseen]) > 0.8
    assert {r.score for r in quality_classifier.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, labels).count() == 0


def test_rising():
    got = quality_classifier.rising(np.arange(5.0), np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.array([1, 3, 1, 1, 2]))
    assert np.allclose(got, [0.125, 0.125, 0.45, 0.45, 0.9])


@pytest.mark.parametrize("n_words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, n_words, percent):
    kind = near_dedup.Similarity(words=n_words, percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, kind).collect()}
    assert got == brute.near_components(rows, n_words, percent)


def test_near_duplicates_of_odd_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    text = "a b c d e f g h"
    odd = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    kept = near_dedup.stage(spark, odd, "")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 5]
    unlike = [(5, text, "x"), (5, text, "b"), (5, text, None), (5, "other words of the same id stay as well", "x"), (9, text, "a")]
    kept = near_dedup.stage(spark, spark.createDataFrame(unlike, "doc_id long, text string, source string"), "")
    assert sorted((r.text, r.source or "") for r in kept.collect()) == [(text, ""), ("other words of the same id stay as well", "x")]


def test_words_of_equal_structure(spark):
    """Words of two letters in the Thue-Morse order and its mirror, which polynomials modulo a power of two cannot tell apart."""
    from tokenizers import Tokenizer

    mirror, word = str.maketrans("ab", "ba"), "a"
    while len(word) < 2048:
        word += word.translate(mirror)
    one = [f"k{k}" for k in range(19)]
    texts = [(i, " ".join([*one[:k], w, *one[k:]])) for i, (k, w) in enumerate([(3, word), (3, word.translate(mirror)), (9, word), (9, word)])]
    table = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table).collect()}
    assert got == brute.repeated_words(texts, 20)
    kind = near_dedup.Similarity(words=3, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table, kind).collect()} == brute.near_components(texts, 3, 85)
    path = packing._tokenizer_path()
    plain = Tokenizer.from_file(path)
    crc = {i: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(table, path).collect()} == crc


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A chain of texts, each a little unlike the one before, over several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    w = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w[k:k + 120])) for k in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Similarity(words=3, percent=85))
    assert {r.component_id for r in got.collect()} == {0}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 440)]
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing._tokenizer_path()
    plain = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(200, "don't <|endoftext|>x ÀÉ ́a"), (201, "12 ''s ###"), (None, "a b"), (3, "one")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd)
    out = packing.pack(table, path, capacity=64).collect()
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in [*rows, *map(tuple, odd.collect())]]
    pieces = sorted((i if i is not None else -1, a, min(64, len(ids) - a), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes()), len(ids))
                    for i, ids in want for a in range(0, len(ids), 64))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == pieces
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    totals = []
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        totals.append(at)
    assert sorted(by_sequence) == list(range(len(totals))) and max(totals) <= 64
    assert sum(totals) >= 0.97 * 64 * (len(totals) - 1)
    assert packing.pack(empty, path).count() == 0


def test_fullest_window():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(r.randrange(0, 7))}
        room = r.randrange(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        got = packing.fullest(counts, room)
        assert all(0 < n <= counts[x] for x, n in got.items()) and sum(x * n for x, n in got.items()) == max(sums)


def test_secret_scan(docs, rows, empty):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan(docs).collect()}
    assert got == {i: brute.secrets(t) for i, t in rows}
    assert secret_scan.scan(empty).count() == 0


def test_redaction(spark, docs, rows):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        assert brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text or "")
        assert r.text == text or any(f"[{k.kind}]" in r.text for k in secret_scan.RULES)


def test_private_keys(spark):
    """The whole block is one span and leaves nothing when redacted."""
    r = random.Random(9)
    body = ["".join(r.choice("ABCDEFabcdefghijkz0189+/") for _ in range(64)) for _ in range(20)] + ["Qk9keQ=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    blocks = [e.join([begin, *body, end]) for e in ("\n", "\r\n", "\\n", " ", '\\n" +\n  "', "\n# ", "<br>")]
    blocks.append("\n".join(["-----BEGIN PGP PRIVATE KEY BLOCK-----", "Version: 2", "", *body, "=aB3d", "-----END PGP PRIVATE KEY BLOCK-----"]))
    blocks += ["\n".join([begin, *fields, *body, end]), "\n".join([begin, *body]), "\n".join([begin, *fields, *body]), "\\n".join([begin, *body])]
    texts = [f"é before {b}\n, after: words go on" for b in blocks] + [f"é before {begin}\nMIIEvQ", f"é before {blocks[0]}\n{blocks[1]}"]
    out = {x.doc_id: x for x in secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in range(len(blocks)):
        assert out[k].text == "é before [private_key]\n, after: words go on", (k, out[k].text)
    assert out[len(blocks)].text == "é before [private_key]" and out[len(blocks) + 1].text == "é before [private_key]\n[private_key]"
    prose = [f"The line {begin} begins a key; see the manual.", f"Look for {begin} in the file\nand remove it"]
    for row in secret_scan.redact(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")).collect():
        assert row.text == prose[row.doc_id].replace(begin, "[private_key]")


def test_strips_and_long_texts(monkeypatch):
    """Segments cut into strips give what uncut ones give, and hostile long texts take time in proportion to their length."""
    import re
    import time

    import numpy as np

    r = random.Random(11)
    parts = ["password", " ", "   ", "=", ": ", "hunter22secret", "AKIA", "ABCDEFGH0123", "deadbeef0123", "eyJ", "a.b", "x" * 9, "ghp_", "-----BEGIN ", "PRIVATE KEY-----", "é"]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 60))) for _ in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = secret_scan.spans(data, offsets)
    assert len(whole) > 100
    monkeypatch.setattr(secret_scan, "STRIP", 7)
    assert secret_scan.spans(data, offsets) == whole
    monkeypatch.undo()
    for k, rule in enumerate(secret_scan.RULES):  # longest is what the greedy patterns of these rules find
        for row, text in enumerate(texts):
            plain = [m.span() for m in re.finditer(rule.found.encode(), text.encode()) if re.fullmatch(rule.kept.encode(), m.group())]
            assert [(a, b) for a, j, b in whole.get(row, []) if j == k] == plain or rule.rests
    for text in (b"eyJa" * 250_000, b"token =" + b" " * 1_000_000, b"some words " * 400_000, b"deadbeef0123" * 100_000,
                 b"-----BEGIN PRIVATE KEY-----\n" * 30_000):
        start = time.time()
        secret_scan.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert time.time() - start < 30, text[:20]


def test_places_of_too_long_texts_fail():
    import numpy as np

    mark = np.zeros(1, np.int64)
    last = np.array([(1 << 30) - 1])
    assert [x.tolist() for x in suffix_dedup._spans(suffix_dedup._placed(last, last + 50, mark))] == [last.tolist(), (last + 50).tolist()]
    with pytest.raises(ValueError, match="bytes or more"):
        suffix_dedup._placed(last + 1, last + 51, mark)


def test_automaton():
    import re

    patterns = ["(?i:ab|a_?c)+x", "[0-9a-c]{2,3}y?", r"\x41\.*[=:]"]
    both = compile_patterns(patterns, anywhere=False)
    r = random.Random(5)
    for _ in range(3000):
        s = "".join(r.choice("abcABx_y01.=:") for _ in range(r.randrange(7))).encode()
        state = 0
        for byte in s:
            state = both.moves[state, byte]
        assert both.accepts[state] == sum(1 << k for k, p in enumerate(patterns) if re.fullmatch(p.encode(), s))


@pytest.mark.parametrize("partitions", [1, 5])
def test_repeated_words(docs, rows, partitions):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs.repartition(partitions)).collect()}
    assert got == brute.repeated_words(rows, 20)


@pytest.mark.parametrize("partitions", [1, 5])
def test_shared_bytes(docs, rows, partitions):
    out = suffix_dedup.remove_shared_bytes(docs.repartition(partitions)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute.shared_bytes(rows, 50)


def test_repeats_of_odd_tables(spark, empty):
    long = " ".join(f"w{k}" for k in range(40))
    odd = spark.createDataFrame([(None, long), (5, long), (5, long), (5, long + " more"), (9, long), (4, "\0" * 120), (8, "\0" * 70)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == [(-1, 0), (4, 0), (5, 0), (5, 0), (5, 0), (8, 0), (9, 40)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_shared_bytes(odd).collect())
    assert got == [(-1, 0), (4, 0), (5, 0), (5, 0), (5, 0), (8, 70), (9, len(long))]
    assert substring_dedup.remove_repeats(empty).count() == suffix_dedup.remove_shared_bytes(empty).count() == 0


def test_strings_of_one_anchor_over_many_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 100)
    out = suffix_dedup.remove_shared_bytes(docs.repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute.shared_bytes(rows, 50)


def test_strings_of_a_frequent_line(spark, monkeypatch):
    """A line shorter than a string, with other text around it in each document: no key gathers all its strings."""
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOWS", 1000, raising=False)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1, raising=False)
    r = random.Random(12)

    def word(n):
        return "".join(r.choice("abcdefghijklmnop") for _ in range(n))

    line, rows = word(40), []
    for i in range(400):
        rows.append((i, word(60) + line + word(60) if i % 5 or not i else rows[i - 4][1][20:] + word(9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix_dedup.remove_shared_bytes(docs).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out} == brute.shared_bytes(rows, 50)
    texts = suffix_dedup.keyed(docs)

    def most_strings():
        sent = suffix_dedup.sent_rows(texts, suffix_dedup.packed(texts), suffix_dedup.copies(texts), 50, 16).where("stretch is not null")
        return sent.groupBy("spread").agg(F.sum(F.octet_length("stretch") - 49).alias("n")).agg(F.max("n")).first()[0]

    assert most_strings() <= 1000
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOWS", 1 << 40)
    assert most_strings() > 1000


@pytest.mark.parametrize("letters,n", [(1, 90), (2, 400), (20, 1500)])
def test_suffix_array(letters, n):
    text = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    text[n // 2:n // 2 + n // 4] = text[:n // 4]
    raw = text.tobytes() + b"\0" * 50
    order, _ = suffix_order(text, np.arange(n), 50)
    assert order.tolist() == sorted(range(n), key=lambda i: (raw[i:i + 50], i))
    for k, shared in enumerate(common_prefixes(text, order, 50)[1:].tolist(), 1):
        a, b = raw[order[k - 1]:order[k - 1] + 50], raw[order[k]:order[k] + 50]
        assert a[:shared] == b[:shared] and (shared == 50 or a[shared] != b[shared])


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((600, 16)).astype(np.float32)
    vectors[40:140] = vectors[40]
    data = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0] * 15 + [None]), (None, [1.0] * 16), (605, [1.0] * 5)]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    out = neighbours.nearest(table, table.where(F.col("vec_id") % 20 == 0)).collect()
    exact, recall = vectors.astype(float), []
    assert {r.query_id for r in out} == set(range(0, 600, 20))
    for q in range(0, 600, 20):
        score = (exact * exact[q]).sum(axis=1)
        best = [int(k) for k in np.lexsort((np.arange(600), -score)) if k != q][:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == score[m[1]] for m in mine)
        recall.append(len(set(best) & {m[1] for m in mine}) / 20)
    assert np.mean(recall) >= 0.9
    few = neighbours.nearest(table.where("vec_id < 5"), table.where("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Answers hold ids: rows of one id, alike or with other vectors, do not push out other ids."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((300, 16)).astype(np.float32)
    vectors[50] = vectors[51] = 3 * vectors[0]
    rows = [(k, v) for k, v in enumerate(vectors)] * 2 + [(50, vectors[50])] * 40
    rows += [(70, (3 * vectors[20] + 0.01 * rng.standard_normal(16)).astype(np.float32)) for _ in range(400)]
    rows += [(0, vectors[7])]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<float>")
    out = neighbours.nearest(table, table.where(F.col("vec_id") % 20 == 0)).collect()
    ids, exact = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    recall = []
    for q in range(0, 300, 20):
        scores = (exact @ exact[ids == q].T).max(axis=1)
        of_id = {k: scores[ids == k].max() for k in range(300) if k != q}
        best = sorted(of_id, key=lambda k: (-round(of_id[k], 9), k))[:20]
        mine = {r.vec_id: r for r in out if r.query_id == q}
        assert sorted(r.rank for r in mine.values()) == list(range(1, 21))
        recall.append(len(set(best) & {k for k in mine if abs(mine[k].score - of_id[k]) < 1e-9}) / 20)
        if q == 0:
            assert {50, 51} <= set(mine)
    assert np.mean(recall) >= 0.9


def test_mixing(spark, docs, labels, empty):
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")).withColumn(
        "text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " the of and").otherwise(" le la et")))
    for weights in (None, [0.2, 0.8], [0.0, 1.0]):
        out = mixing.mix_documents(known, labels, weights).collect()
        p, tokens, rate = (np.array([r[c] for r in out], float) for c in ("posterior", "tokens", "rate"))
        totals = (p * tokens[:, None]).sum(axis=0)
        assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
        reached, wanted = (p * (tokens * rate)[:, None]).sum(axis=0), np.array(mixing.targets_of(totals, weights))
        assert np.abs(reached - wanted).sum() <= (1e-4 if weights != [0.0, 1.0] else 0.05) * wanted.sum()
        assert all(np.floor(r.rate) <= r.n_copies <= np.ceil(r.rate) for r in out)
        assert np.mean([r.domain == ("en" if r.doc_id % 2 == 0 else "fr") for r in out]) > 0.9
    alone = mixing.mix_documents(known, labels.limit(0)).collect()
    assert {(r.domain, r.posterior[0]) for r in alone} == {("all", 1.0)} and min(r.n_copies for r in alone) >= 1
    assert mixing.mix_documents(empty, labels).count() == 0


def test_merkle_audit(spark):
    pages = [(k, f"http://x/{k}", "é" * (k % 90)) for k in range(2500)] + [(5, None, None), (None, "u", "h")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    ours = merkle_audit.manifest(table)
    assert merkle_audit.audit(ours, ours).count() == 0
    at, want = {}, {}
    for p, url, html in sorted((x for x in pages if x[0] is not None), key=lambda x: (x[0], x[1] is None)):
        body = (html or "").encode()
        size = len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{p}>\r\nWARC-Target-URI: {url or ''}\r\n"
                   f"Content-Length: {len(body)}\r\n\r\n".encode()) + len(body) + 4
        want.setdefault(p, []).append((p // 1024, at.get(p // 1024, 0), size))
        at[p // 1024] = at.get(p // 1024, 0) + size
    got = {}
    for r in merkle_audit.audit(ours, merkle_audit.damaged(ours)).collect():
        fault = zlib.crc32(str(r.position).encode())
        assert r.status == ("missing" if fault % 211 == 3 else "content" if fault % 53 == 7 else None)
        if r.position != 5:
            assert [(r.file, r.offset, r.length)] == want[r.position]
        got.setdefault(r.position, []).append(r.status)
    assert set(got) == {p for p in range(2500) if zlib.crc32(str(p).encode()) % 211 == 3 or zlib.crc32(str(p).encode()) % 53 == 7}
    moved = ours.where("position <> 700").withColumn("offset", F.when(F.col("position") == 3, F.col("offset") + 1).otherwise(F.col("offset")))
    grown = moved.union(ours.where("position = 1").select(F.lit(99_999).cast("long"), F.lit(97).cast("long"), "offset", "length", "digest"))
    assert sorted((r.position, r.status) for r in merkle_audit.audit(ours, grown).collect()) == [(3, "range"), (700, "missing"), (99_999, "extra")]
    assert merkle_audit.audit(ours.limit(0), ours.limit(0)).count() == 0
