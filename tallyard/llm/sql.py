"""DuckDB SQL for the corpus queries that SQL can express."""

_X = "CAST(('0x' || substr(md5(line), 1, 7)) AS BIGINT)"
OP1 = rf"""
WITH given AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
P AS (SELECT doc_id, u.i - 1 AS i, u.line AS line, len(regexp_extract_all(u.line, '[^ \t\r\n]+')) AS words
      FROM given, unnest(list_transform(lines, lambda x, i: {{'i': i, 'line': x}})) AS t(u) WHERE text <> ''),
N AS (SELECT *, CAST(sum(CAST(words > 0 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM P),
L AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, line, words, part, height FROM
      (SELECT doc_id, n, min_by(line, i) AS line, sum(words) AS words, string_agg(line, chr(10) ORDER BY i) AS part, count(*) AS height FROM N GROUP BY doc_id, n)),
docs AS (SELECT g.doc_id, g.text, len(g.lines) AS n_lines, coalesce(l.lines, ['']) AS lines FROM given g LEFT JOIN (SELECT doc_id, list(line ORDER BY i) AS lines FROM L GROUP BY doc_id) l ON l.doc_id = g.doc_id),
R AS (SELECT *, (lag(x) OVER w * 31 + x) % 268435399 AS roll, lead(words) OVER w AS next_words, lead(i) OVER w AS next_i
      FROM (SELECT *, {_X} AS x FROM L) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT DISTINCT doc_id, CASE WHEN roll <= next_roll THEN i ELSE i + 1 END AS b FROM (SELECT *, lead(roll) OVER (PARTITION BY doc_id ORDER BY i) AS next_roll FROM R) WHERE roll IS NOT NULL AND next_roll IS NOT NULL
         UNION SELECT doc_id, i FROM R WHERE words >= 13 OR next_words >= 13 OR next_i IS NULL),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b) + 1, 0) AS a, b FROM ends),
C AS (SELECT * FROM (SELECT cut.*, array_to_string(list_slice(lines, a + 1, b + 1), chr(10)) AS body FROM cut JOIN docs USING (doc_id)) WHERE regexp_matches(body, '[^ \t\r\n]')),
F AS (SELECT body, min(struct_pack(doc_id := doc_id, a := a)) AS place FROM C GROUP BY body HAVING count(*) > 1),
later AS (SELECT DISTINCT c.doc_id, f.doc0, c.a - f.a AS shift,
    c.a - CASE WHEN c.a < 1 OR f.a < 1 OR d.lines[c.a] <> s.lines[f.a] THEN 0 WHEN c.a < 2 OR f.a < 2 OR d.lines[c.a - 1] <> s.lines[f.a - 1] THEN 1 WHEN c.a < 3 OR f.a < 3 OR d.lines[c.a - 2] <> s.lines[f.a - 2] THEN 2 ELSE 3 END AS a,
    c.b + CASE WHEN len(d.lines) < c.b + 2 OR len(s.lines) < f.b + 2 OR d.lines[c.b + 2] <> s.lines[f.b + 2] THEN 0 WHEN len(d.lines) < c.b + 3 OR len(s.lines) < f.b + 3 OR d.lines[c.b + 3] <> s.lines[f.b + 3] THEN 1
               WHEN len(d.lines) < c.b + 4 OR len(s.lines) < f.b + 4 OR d.lines[c.b + 4] <> s.lines[f.b + 4] THEN 2 ELSE 3 END AS b
  FROM (SELECT C.*, F.place.doc_id AS doc0, F.place.a AS a0 FROM C JOIN F ON F.body = C.body WHERE C.doc_id <> F.place.doc_id OR C.a <> F.place.a) c
  JOIN LATERAL (SELECT c.doc0 AS doc0, c.a0 AS a, c.a0 + c.b - c.a AS b) f ON true JOIN docs d ON d.doc_id = c.doc_id JOIN docs s ON s.doc_id = c.doc0),
grown AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, doc0, shift ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM
  (SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_id, doc0, shift ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= a THEN 0 ELSE 1 END AS fresh FROM later)) GROUP BY doc_id, doc0, shift, n),
marked AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, a, b FROM grown)),
islands AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM marked) GROUP BY doc_id, n),
sized AS (SELECT s.doc_id, s.a, s.b, sum(l.words) AS words FROM islands s JOIN L l ON l.doc_id = s.doc_id AND l.i BETWEEN s.a AND s.b GROUP BY ALL),
gone AS (SELECT * FROM sized WHERE words >= 50),
per AS (SELECT g.doc_id, sum(l.height) AS n_lines, sum(l.words) AS n_words FROM gone g JOIN L l ON l.doc_id = g.doc_id AND l.i BETWEEN g.a AND g.b GROUP BY g.doc_id),
kept AS (SELECT l.doc_id, string_agg(l.part, chr(10) ORDER BY l.i) AS text FROM L l
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.i BETWEEN g.a AND g.b) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text <> '' THEN d.n_lines ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(p.n_words, 0) AS BIGINT) AS n_removed_words, CASE WHEN p.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN per p ON p.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM w
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS body
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS body FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.k, p.n, q.item_id FROM places p JOIN win q ON q.n = p.n AND q.body = p.body),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(k, k + n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

# CRC-32 of a string: a table of 256 numbers, then a fold over the bytes.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) AS t(i))"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of text's UTF-8 bytes, beside the relation crc."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, u.word, count(*) AS n FROM d, unnest(w) AS u(word) GROUP BY ALL),
bw AS (SELECT u.word, count(*) AS n FROM b, unnest(w) AS u(word) GROUP BY ALL),
spelt AS (SELECT word, {_crc("word")} % 10000 AS k FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM dw JOIN spelt USING (word) GROUP BY k),
t AS (SELECT k, sum(n)::DOUBLE AS t FROM bw JOIN spelt USING (word) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
      FROM s FULL JOIN t USING (k)),
weights AS (SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN spelt USING (word) JOIN g USING (k) GROUP BY doc_id),
sc AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
       FROM d LEFT JOIN weights USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r ON r.doc_id = sc.doc_id
"""

# The given pages have one template: an article of headings and paragraphs is their main text.
OP12 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<!--.*?-->', '', 'gs') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x:
        trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

OP13 = rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
c AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS c0 FROM (SELECT DISTINCT conv_id FROM t), crc),
b AS (SELECT c.conv_id, 0 AS own, o.n, role, text FROM c JOIN o ON o.conv_id = c.c0 AND o.n <= c.h
      UNION ALL SELECT c.conv_id, 1, o.n, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, text, string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER w AS k
      FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, 0 AS depth, '' AS text, '' AS k FROM c UNION ALL SELECT * FROM r),
l AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS most, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS pk FROM a),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(pk) AS pk, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = most), '')) AS ends_sha256 FROM l GROUP BY k, depth),
m AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(q.n, 0) AS n_children FROM n LEFT JOIN n p ON p.k = n.pk LEFT JOIN (SELECT pk, count(*) AS n FROM n GROUP BY pk) q ON q.pk = n.k),
s AS (SELECT a.k, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens FROM m JOIN a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.k)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM m JOIN s ON s.k = m.k
"""

ORACLES = {"op1_line_dedup": OP1, "op5_warc": OP5, "op7_decontaminate": OP7, "op11_resampling": OP11, "op12_html_extraction": OP12, "op13_conversation_trie": OP13}
