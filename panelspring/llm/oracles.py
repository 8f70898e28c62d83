"""SQL of the conversation and spelling queries, with CRC-32 spelled out as a table and a fold over bytes."""

from __future__ import annotations


def _crc_table() -> str:
    """crct: one row with the list of 256 entries of the reversed polynomial."""
    q = "SELECT i, CAST(i AS BIGINT) AS v FROM range(256) AS r(i)"
    for _ in range(8):
        q = f"SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM ({q})"
    return f"crct AS (SELECT list(v ORDER BY i) AS crct FROM ({q}))"


def _crc(text: str) -> str:
    """CRC-32 of a text of ASCII characters and U+00C0 to U+00FF, which have two bytes."""
    byte = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN unicode({text}[i]) < 128 THEN [unicode({text}[i])::BIGINT] ELSE [195::BIGINT, unicode({text}[i]) - 64] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: xor(c // 256, crct[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"


# Every prefix of every rebuilt conversation, grouped; subtrees are the nodes that begin with the node.
OP11 = rf"""
WITH {_crc_table()},
own AS (SELECT conv_id, list(struct_pack(d := md5(coalesce(role, '') || chr(1) || coalesce(text, '')), w := len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {_crc("s")} % 4 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM own) CROSS JOIN crct),
whole AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1 : h], []), h.ts[h + 1 : ]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
prefixes AS (SELECT conv_id, len(ts) AS n, d, list_transform(ts[1 : d], lambda t: t.d) AS path, coalesce(ts[d].w, 0) AS w FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM whole)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM prefixes GROUP BY path, d),
kin AS (SELECT a.path, count(*) FILTER (b.d = a.d + 1) AS n_children, sum((b.n_convs - 1) * b.w) AS saved_tokens FROM nodes a JOIN nodes b ON b.d >= a.d AND b.path[1 : a.d] = a.path GROUP BY a.path),
leaf AS (SELECT n.path FROM nodes n JOIN kin k ON k.path = n.path WHERE k.n_children = 0),
leaves AS (SELECT a.path, count(*) AS n_leaves FROM nodes a JOIN leaf b ON b.path[1 : a.d] = a.path GROUP BY a.path)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, k.n_children, l.n_leaves, CAST(k.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a JOIN kin k ON k.path = a.path JOIN leaves l ON l.path = a.path LEFT JOIN nodes p ON p.d = a.d - 1 AND p.path = a.path[1 : a.d - 1] AND a.d > 0
"""

# Marks and escapes are counted, not written; texts need no reading back here.
_ESCAPES = r"len(regexp_extract_all({0}, '<\\*/?s>|\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT)\]'))"
OP12 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, row_number() OVER w - 1 AS k, lag(role, 1, '') OVER w AS state, lead(role) OVER w IS NULL AS ends FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, ((state = '' AND role IN ('system', 'user')) OR (state = 'system' AND role = 'user') OR (state = 'user' AND role = 'assistant') OR (state = 'assistant' AND role = 'user')) AND (NOT ends OR role = 'assistant') AS allowed,
  CASE WHEN state IN ('', 'assistant') THEN length('<s>') ELSE 0 END + length(text) + {_ESCAPES.format("text")}
  + CASE role WHEN 'system' THEN length('[SYS]  [/SYS]') WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length(' </s>') ELSE length('[ROLE]  [TEXT]  [/ROLE]') + length(role) + {_ESCAPES.format("role")} END AS chars
  FROM s),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, min(CASE WHEN NOT allowed THEN k END) AS first_error FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, first_error IS NULL AS valid, first_error FROM g
"""

# Words that are near share the word less one letter, or with one letter left blank.
OP13 = rf"""
WITH RECURSIVE {_crc_table()},
runs AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents) WHERE length(word) >= 6 GROUP BY ALL),
coded AS (SELECT word, n, {_crc("s")} AS h FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word AS s FROM runs) CROSS JOIN crct),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN word[1 : h % length(word)] || word[h % length(word) + 2 : ] ELSE word END AS word, n FROM coded),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, word[1 : k] || word[k + 2 : ] AS less, word[1 : k] || '#' || word[k + 2 : ] AS blank FROM (SELECT *, unnest(range(0, length(word))) AS k FROM w)),
pairs AS (SELECT DISTINCT * FROM (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.blank = b.blank AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.less = b.word UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.less = b.word)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM pairs),
best AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
up(word, root, form) AS (SELECT word, word, form FROM best UNION ALL SELECT u.word, b.word, b.form FROM up u JOIN best b ON b.word = u.form)
SELECT b.word, b.form, u.root, b.n, b.n_near, b.form_n FROM best b JOIN up u ON u.word = b.word AND u.form IS NULL
"""
