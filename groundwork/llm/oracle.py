"""DuckDB SQL for those queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, i, item_id FROM win JOIN pat USING (m, g)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit),
a AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
b AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
      FROM hit GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

OP5 = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS v
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY 1, 2, 3)
SELECT u.page_id, u.host, u.path, m.rule,
  coalesce(m.v, CASE WHEN
    regexp_matches(u.host, '(?i)(^|[^a-z0-9])(adult|casino|lottery|malware|phishing|pills|poker|porn|spam|viagra|warez|xxx)([^a-z0-9]|$)')
    OR regexp_matches(u.path, '(?i)(^|[^a-z0-9])(casino|phishing|porn|viagra|warez|xxx)([^a-z0-9]|$)')
    OR regexp_matches(u.query, '(?i)(^|[&;])(jsessionid|phpsessid|sessionid)=')
    OR regexp_matches(u.path, '(?i)(/wp-login\.php$|/cgi-bin/|\.exe$)')
    OR regexp_matches(u.host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m USING (page_id, host, path)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
        source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS open_level FROM l),
t AS (SELECT source, source_size, CASE WHEN open_level IS NULL THEN cap ELSE least(cap, open_level * weight) END AS target FROM o),
j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM j
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS lead FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY 1)
SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN lead > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN lead > page_id THEN lead END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS g FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT x AS doc_id, x AS root FROM e WHERE x = y UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.root),
c AS (SELECT doc_id, min(root) AS low FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: The reflected polynomial of CRC-32, four bits at a time.
_NIBBLE = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
for _ in range(4):
    _NIBBLE = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in _NIBBLE]


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: its hexadecimal digits, lower one of a byte first."""
    digits = f"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '')"
    values = f"[4294967295::BIGINT] || list_transform({digits}, lambda p: (strpos('0123456789ABCDEF', p) - 1)::BIGINT)"
    tab = "[" + ", ".join(f"{x}::BIGINT" for x in _NIBBLE) + "]"
    return f"(CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce({values}, lambda a, n: xor({tab}[(xor(a, n) & 15) + 1], a >> 4)), 4294967295::BIGINT) END)"


def _hex32(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


OP11 = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, {_LOWER.replace("text", "w")} AS w
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)),
o AS (SELECT k, w, count(*) AS c, {crc32_sql("k || ':' || w")} AS h FROM r GROUP BY 1, 2),
t AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM o),
v AS (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM v),
x AS (SELECT word, n, left(word, pos - 1) || substr(word, pos + 1) AS less, left(word, pos - 1) || chr(0) || substr(word, pos + 1) AS other FROM i),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM x a JOIN v b ON a.less = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM x a JOIN v b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN x b ON a.other = b.other AND a.word <> b.word),
s AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM p GROUP BY 1),
b AS (SELECT word, arg_min(near, encode(near)) AS near FROM p JOIN s USING (word) WHERE near_n = m GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN s USING (word) LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, form AS nxt FROM f
  UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.nxt)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN w ON w.word = f.word AND w.nxt IS NULL
"""

OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {crc32_sql("coalesce(text, '')")}::BIGINT AS crc
  FROM documents),
j AS (SELECT DISTINCT k, -1::BIGINT AS b, 0::BIGINT AS nxt FROM d
  UNION ALL SELECT k, nxt, ((nxt + 1) * 4294967296) // ({_hex32("k || ':' || CAST(nxt AS VARCHAR)")} + 1) FROM j WHERE nxt < 9),
s AS (SELECT k, max(b) FILTER (b < 8) AS shard, max(b) FILTER (b < 9) AS grown FROM j GROUP BY 1)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY {_hex32("k || ':' || CAST(size AS VARCHAR) || ':' || CAST(crc AS VARCHAR)")} % 4096, doc_id NULLS FIRST, size, crc) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM d JOIN s USING (k)
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS ln FROM o GROUP BY 1, 2 HAVING count(*) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY 1),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n)::HUGEINT AS t FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.t, 0) + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (ln + 2)) // (lt + 2 * v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""

ORACLE = {"op11_spelling": OP11, "op12_sharding": OP12, "op13_divergence": OP13, "op7_jaccard_join": OP7, "op2_warc": OP2, "op4_top_k": OP4, "op1_decontaminate": OP1, "op5_url_filter": OP5, "op6_mixing": OP6}
