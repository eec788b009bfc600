"""DuckDB SQL for the queries that SQL can express by a plainer way."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: CRC-32 (reflected polynomial 0xEDB88320) over the bytes of a text, by the usual table of 256 remainders.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs FROM range(256) t(n))"
_UNIT = "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _home(shards: int) -> str:
    key = _UNIT.format("k || ':' || i")
    return f"list_min(list_transform(range({shards}), lambda i: {{'at': -ln({key}), 'id': i}})).id::INT"


OP3 = f"""
WITH b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS x FROM documents),
h AS (SELECT doc_id, k, (octet_length(encode(x)) + 16)::BIGINT AS size, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda c: ('0x' || c)::BIGINT) AS bytes FROM b),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, crcs[xor(c & 255, y) + 1])), 4294967295)::BIGINT AS text_crc32 FROM h, {_CRC_TABLE}),
s AS (SELECT *, {_home(40)} AS shard, {_home(41)} AS grown_shard,
 {_UNIT.format("concat_ws(':', k, 'slot', CASE WHEN doc_id IS NULL THEN text_crc32::VARCHAR END)")} AS spot FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY spot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

#: Every term of a query against every document; scores to 6 places, as the query returns them.
OP6 = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS length FROM f GROUP BY 1),
g AS (SELECT count(*) AS n, avg(length) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
 FROM f q JOIN d ON d.term = q.term JOIN f ON f.term = q.term JOIN l ON l.doc_id = f.doc_id, g WHERE q.doc_id % 50 = 0 AND f.doc_id <> q.doc_id GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""

#: Jaccard similarities of all documents that share a shingle, and what is reached over links.
OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, least(5, len(ws)) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT doc_id, n, count(*) OVER w AS c, string_agg(word, ' ') OVER w AS shingle FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, md5(shingle) AS h FROM g WHERE c = n), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
 UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id > b.doc_id),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT id AS doc_id, min(root) AS class_id FROM r GROUP BY id UNION ALL SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NULL
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT doc_id, p, word, CASE WHEN count(*) OVER w = 50 THEN md5(string_agg(word, ' ') OVER w) END AS h FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT h, min(doc_id) AS first_id FROM g WHERE h IS NOT NULL GROUP BY h),
m AS (SELECT g.doc_id, p, word, coalesce(first_id < g.doc_id, false)::INT AS starts FROM g LEFT JOIN f USING (h)),
c AS (SELECT doc_id, p, word, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: Neighbours by the words that are left when one letter goes: from one word they give the other, or both leave the same.
OP12 = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT k, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM g),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, y: xor(a >> 8, crcs[xor(a & 255, y) + 1])), 4294967295)::BIGINT AS h FROM b, {_CRC_TABLE}),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v), x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
e AS (SELECT x.word AS a, x.n AS an, v.word AS b, v.n AS bn FROM x JOIN v ON x.rest = v.word),
p AS (SELECT a, an, b, bn FROM e UNION SELECT b, bn, a, an FROM e UNION SELECT q.word, q.n, z.word, z.n FROM x q JOIN x z ON q.rest = z.rest AND q.i = z.i AND q.word <> z.word),
m AS (SELECT a, count(*) AS n_near, (min_by(b, (-bn, b)), max(bn))::ROW(form VARCHAR, n BIGINT) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 5 * n THEN best.form END AS form, CASE WHEN best.n >= 5 * n THEN best.n END AS form_n FROM v LEFT JOIN m ON m.a = v.word),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
l AS (SELECT w.word, w.at AS root FROM w JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l ON l.word = f.word
"""

#: Cuts as positions in the text, from the lengths of the units before them.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes FROM d),
c AS (SELECT *, len(sizes) AS n, ('0x' || h[1:8])::BIGINT % (len(sizes) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(sizes) + 1) AS b,
 t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm FROM u),
s AS (SELECT *, coalesce(list_sum(sizes[1:least(a, b)]), 0)::BIGINT AS p, coalesce(list_sum(sizes[1:greatest(a, b)]), 0)::BIGINT AS q FROM c),
o AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM s)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
 CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN spm THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM o
"""
