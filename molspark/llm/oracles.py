"""DuckDB SQL of the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i : i + n - 1], ' ') AS win, n FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) AS x),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS s WHERE len(w) >= n) AS x),
m AS (SELECT rid, i, dw.n AS n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) AS x GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) AS x GROUP BY rid),
-- near windows: their four rarest words, ties by place, all within three words of their places relative to the rarest
p AS (SELECT rid, i, w[i] AS word FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS x),
f AS (SELECT word, count(*) AS f FROM p GROUP BY word),
bt AS (SELECT item, win, o, string_split(win, ' ')[o + 1] AS word FROM (SELECT item, win, unnest(range(0, n)) AS o FROM bw) AS x),
br AS (SELECT bt.*, row_number() OVER (PARTITION BY item, win ORDER BY coalesce(f, 0), o) AS k FROM bt LEFT JOIN f USING (word)),
b1 AS (SELECT br.item, br.win, p.rid, p.i - br.o AS base FROM br JOIN p USING (word) WHERE k = 1),
bn AS (SELECT item, win, count(*) AS need FROM br WHERE k BETWEEN 2 AND 4 GROUP BY 1, 2),
bm AS (SELECT b1.item, b1.win, b1.rid, b1.base, count(DISTINCT br.k) AS met FROM b1 JOIN br ON br.item = b1.item AND br.win = b1.win AND br.k BETWEEN 2 AND 4
  JOIN p ON p.rid = b1.rid AND p.word = br.word AND p.i BETWEEN b1.base + br.o - 3 AND b1.base + br.o + 3 GROUP BY 1, 2, 3, 4),
ni AS (SELECT DISTINCT b1.rid, b1.item FROM b1 LEFT JOIN bn USING (item, win) LEFT JOIN bm USING (item, win, rid, base) WHERE coalesce(met, 0) = coalesce(need, 0)),
nt AS (SELECT rid, count(*) AS n_near_items, string_agg(item, ',' ORDER BY item) AS near_items FROM ni GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN nt USING (rid)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT rid, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0) AS x),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
e AS (SELECT p.a, p.b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.g = y.g AND x.rid <> y.rid GROUP BY 1, 2) AS p
  JOIN c AS ca ON ca.rid = p.a JOIN c AS cb ON cb.rid = p.b WHERE 5 * k >= 4 * (ca.n + cb.n - k)),
r AS (SELECT rid AS node, rid AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, (SELECT min(x.doc_id) FROM r JOIN d AS x ON x.rid = r.reach WHERE r.node = d.rid) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.rid) AS n_links FROM d
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT rid, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] END AS w0, CASE WHEN i > 2 THEN w[i - 2] END AS w00 FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS x),
c AS (SELECT rid, i, count(*) OVER () - count(*) OVER (PARTITION BY rid) AS rest,
  count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY rid, w1) AS c1,
  count(*) OVER (PARTITION BY w0, w1) - count(*) OVER (PARTITION BY rid, w0, w1) AS c2,
  count(*) OVER (PARTITION BY w00, w0, w1) - count(*) OVER (PARTITION BY rid, w00, w0, w1) AS c3 FROM t),
k AS (SELECT *, lag(c1) OVER (PARTITION BY rid ORDER BY i) AS k1, lag(c2) OVER (PARTITION BY rid ORDER BY i) AS k2 FROM c),
p1 AS (SELECT *, CASE WHEN c1 > 0 THEN c1 ELSE 0.4 END / greatest(rest, 1) AS p FROM k),
p2 AS (SELECT * REPLACE (CASE WHEN i < 2 THEN p WHEN c2 > 0 THEN c2 / k1 ELSE 0.4 * p END AS p) FROM p1),
p3 AS (SELECT * REPLACE (CASE WHEN i < 3 THEN p WHEN c3 > 0 THEN c3 / k2 ELSE 0.4 * p END AS p) FROM p2),
q AS (SELECT rid, count(*) AS n_tokens, sum(log10(p)) AS l FROM p3 GROUP BY rid)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(l, 0), 3) AS lm_log10, round(coalesce(l / n_tokens, 0), 6) AS lm_mean FROM d LEFT JOIN q USING (rid)
"""

#: CRC-32 of a text's UTF-8 bytes, which are counted out from its code points, by a table that is made from the polynomial.
_CRC_TABLE = """SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc"""
_UTF8 = """flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
  WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
  ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END))"""
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_UTF8}), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295)"

#: Shards by the middle of each row's interval of bytes, rows in the order of id and text hash.
OP5 = f"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(text, '')) AS h, CAST({_CRC32} AS BIGINT) AS text_crc32 FROM documents, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, h ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(39, CAST((2 * upto - size) * 40 // (2 * total) AS INT)) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""

#: Near words share what is left without one letter at the same place, or one of them is what is left of the other.
OP12 = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS text, length(run) AS m FROM r WHERE length(run) >= 7),
h AS (SELECT run, m, {_CRC32} AS h FROM c, t),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % m) || substr(run, h % m + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
k AS (SELECT word, 0 AS i, word AS k FROM w UNION ALL SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) AS x),
p AS (SELECT a.word AS x, b.word AS y FROM k AS a JOIN k AS b ON a.k = b.k AND a.i = b.i AND a.i > 0 AND a.word <> b.word
  UNION SELECT a.word, b.word FROM k AS a JOIN k AS b ON a.k = b.k AND a.i = 0 AND b.i > 0 UNION SELECT b.word, a.word FROM k AS a JOIN k AS b ON a.k = b.k AND a.i = 0 AND b.i > 0),
g AS (SELECT x AS word, count(*) OVER (PARTITION BY x) AS n_near, y AS near, w.n AS near_n, row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) AS place FROM p JOIN w ON w.word = y),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN g ON g.word = w.word AND place = 1),
s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL
"""
