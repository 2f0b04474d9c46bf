"""SQL that gives the rows of the queries which SQL can express, for the checking engine."""
from __future__ import annotations

SOURCE_DIVERGENCE = r"""
WITH words AS (
    SELECT r, lang, source, unnest(w) AS term FROM (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY ALL HAVING sum(n_docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
occurring AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
totals AS (SELECT lang, source, sum(n) AS total FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q
    FROM occurring JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

DECONTAMINATION = r"""
WITH doc_words AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
phrases AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words),
found AS (
    SELECT d.r, d.i, p.n, p.item_id
    FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places, sizes WHERE i + n - 1 <= len(w)) d
    JOIN phrases p ON p.p = d.p AND p.n = d.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
checks AS (
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])), 4294967295) % 7 = 0 AS tampered
    FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN crc_table),
texts AS (
    SELECT doc_id AS id, lang, n_chars, CAST(doc_id AS VARCHAR) AS a, source AS b, lang AS c, CAST(n_chars AS VARCHAR) AS n,
        CAST(n_chars::HUGEINT + 1 AS VARCHAR) AS n1, text AS t FROM documents),
parts AS (
    SELECT id, lang, coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-') AS head,
        coalesce(strlen(n) || ':' || n, '-') AS n, coalesce(strlen(n1) || ':' || n1, '-') AS n1, coalesce(strlen(t) || ':' || t, '-') AS tail
    FROM texts),
leaves AS (
    SELECT id, p.lang, sha256(head || n || tail) AS leaf,
        CASE WHEN k.tampered THEN sha256(head || n1 || tail) ELSE sha256(head || n || tail) END AS shown
    FROM parts p LEFT JOIN checks k ON k.doc_id IS NOT DISTINCT FROM p.id),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id NULLS FIRST, leaf) - 1 AS place,
        dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS grp FROM leaves),
tree AS (
    SELECT grp, 0 AS depth, list(leaf ORDER BY place) AS nodes FROM numbered GROUP BY grp
    UNION ALL
    SELECT grp, depth + 1, list_transform(range(1, (len(nodes) + 1) // 2 + 1),
        lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT grp, nodes[1] AS subroot FROM tree WHERE len(nodes) = 1),
top AS (
    SELECT 0 AS depth, list(subroot ORDER BY grp) AS nodes FROM subroots HAVING count(*) > 0
    UNION ALL
    SELECT depth + 1, list_transform(range(1, (len(nodes) + 1) // 2 + 1),
        lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], ''))) FROM top WHERE len(nodes) > 1),
steps AS (
    SELECT n.grp, n.place, 0 AS part, t.depth, (n.place // (1 << t.depth)) % 2 AS side,
        t.nodes[xor(n.place // (1 << t.depth), 1) + 1] AS other
    FROM numbered n JOIN tree t ON t.grp = n.grp AND len(t.nodes) > 1
    UNION ALL
    SELECT n.grp, n.place, 1, t.depth, (n.grp // (1 << t.depth)) % 2, t.nodes[xor(n.grp // (1 << t.depth), 1) + 1]
    FROM numbered n JOIN top t ON len(t.nodes) > 1),
paths AS (
    SELECT grp, place, string_agg(coalesce(other, ''), '' ORDER BY part, depth) AS siblings,
        list(CASE WHEN side = 1 THEN 'L' ELSE 'R' END || coalesce(other, '') ORDER BY part, depth) AS turns
    FROM steps GROUP BY grp, place)
SELECT id AS doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT n.*, s.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, siblings,
        list_reduce(list_prepend(shown, coalesce(turns, [])), lambda x, s:
            CASE WHEN s[1] = 'L' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END) AS folded_root
    FROM numbered n JOIN subroots s USING (grp) LEFT JOIN paths p ON p.grp = n.grp AND p.place = n.place)
"""
