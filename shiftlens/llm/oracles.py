"""DuckDB SQL for the dealt operators that SQL can express.

PPM scores, XXH64 fingerprints, the Feistel network, the forest and the
signature rules have none; tests/llm holds them against brute force.
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op3_winnowing_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op6_temporal_url_lists": r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS day,
                  nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2), '') AS host FROM pages),
t(term, category) AS (VALUES ('ads', 'ads'), ('adult', 'adult'), ('bets', 'gambling'), ('casino', 'gambling'),
                             ('pills', 'pharma'), ('spam', 'spam')),
e AS (SELECT DISTINCT value, category FROM (SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS value FROM c) h
      JOIN t ON contains(value, term)),
l AS (SELECT value, category, DATE '2024-01-01' + CAST(('0x' || md5(value || '+')[1:4])::INTEGER % 182 AS INTEGER) AS start,
             ('0x' || md5(value || '-')[1:4])::INTEGER % 182 + 1 AS days FROM e),
m AS (SELECT page_id, value, category, start,
             row_number() OVER (PARTITION BY page_id ORDER BY start DESC, length(value) DESC, category) AS r
      FROM c JOIN l ON (host = value OR ends_with(host, '.' || value)) AND day >= start AND day < start + CAST(days AS INTEGER)),
f AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
             max(value) FILTER (r = 1) AS entry, max(start) FILTER (r = 1) AS listed_on FROM m GROUP BY 1)
SELECT page_id, url, day, host, coalesce(n, 0) AS n_entries, categories, entry, listed_on, coalesce(n, 0) > 0 AS blocked
FROM c LEFT JOIN f USING (page_id)""",
    "op10_line_site_spread": r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
h AS (SELECT doc_id, source, line, place, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS plain FROM l),
bad AS (SELECT plain FROM h WHERE plain <> '' GROUP BY 1 HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 8),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (plain IN (SELECT plain FROM bad)) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (plain NOT IN (SELECT plain FROM bad)), '') AS kept
      FROM h GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
    "op11_presence_masks": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS t FROM documents),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
       FROM tf, s GROUP BY term, docs),
i AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{WORDS}')) AS term
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
p AS (SELECT item_id, r, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM p WHERE score > 0) WHERE rank <= 10""",
    "op12_truncation_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'id': m, 'chars': length(text)} ORDER BY turn NULLS FIRST, m) AS own
      FROM (SELECT *, md5(strlen(role) || ':' || role || text) AS m FROM t) GROUP BY 1),
h AS (SELECT conv_id, own, CAST(xor(list_reduce(
                list_concat([CAST(4294967295 AS BIGINT)],
                            list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR x IN range(8)]),
                    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)),
                CAST(4294967295 AS BIGINT)) % 6 AS INTEGER) AS heads FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:heads], h.own[heads + 1:]) AS turns
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, len(turns) = d AS ends, coalesce(turns[d].chars, 0) AS chars,
             md5(array_to_string([x.id FOR x IN turns[1:d]], ',')) AS key,
             CASE WHEN d > 0 THEN md5(array_to_string([x.id FOR x IN turns[1:d - 1]], ',')) END AS above
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
n AS (SELECT key, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
             (count(*) - 1) * any_value(chars) AS own,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM m GROUP BY 1, 2),
k AS (SELECT above, count(*) AS n_children FROM n GROUP BY 1),
s AS (SELECT m.key, m.d, CAST(sum(own) AS BIGINT) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
      FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN k ON k.above = n.key GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (key, d) LEFT JOIN k ON k.above = n.key LEFT JOIN n p ON p.key = n.above AND p.d = n.d - 1""",
    "op13_bottom_k": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w
                     FROM documents),
s AS (SELECT DISTINCT r, hash(g) AS g FROM (SELECT r, unnest(CASE
          WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
          ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
t AS (SELECT r AS node, r AS seen FROM d UNION SELECT u.y, t.seen FROM t JOIN u ON u.x = t.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id,
       d.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM d JOIN t ON t.seen = d.r JOIN d o ON o.r = t.node LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id""",
}
