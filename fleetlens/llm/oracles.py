"""DuckDB SQL for the rows of those queries that SQL can express."""

LINES = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), lines AS (
  SELECT doc_id, body, line, CAST(doc_id AS HUGEINT) * 2147483648 + line AS ord,
    list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM split
), classes AS (
  SELECT words, min(ord) AS first FROM lines WHERE len(words) > 0 GROUP BY words
), cuts AS (
  SELECT words, first, gap, list_concat(words[1:gap - 1], words[gap + 1:]) AS v
  FROM (SELECT words, first, unnest(range(1, len(words) + 1)) AS gap FROM classes WHERE len(words) >= 6)
), near AS (
  SELECT DISTINCT c.words FROM cuts c JOIN (SELECT v, gap, min(first) AS least FROM cuts GROUP BY v, gap) g USING (v, gap) WHERE g.least < c.first
  UNION
  SELECT c.words FROM cuts c JOIN classes s ON s.words = c.v WHERE s.first < c.first AND len(s.words) >= 6
  UNION
  SELECT s.words FROM classes s JOIN cuts c ON s.words = c.v WHERE c.first < s.first AND len(s.words) >= 6
), judged AS (
  SELECT l.doc_id, l.line, l.body, coalesce(l.ord > c.first, FALSE) AS exact, n.words IS NOT NULL AS near
  FROM lines l LEFT JOIN classes c ON c.words = l.words LEFT JOIN near n ON n.words = l.words
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
    coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT exact AND NOT near), '') AS left_text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  CAST(strlen(coalesce(left_text, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(left_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

SHARDS = """
WITH sized AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(text, '')) AS key FROM documents
), ordered AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id) AS upto, sum(size) OVER () AS total FROM sized
), placed AS (
  SELECT *, least(39, CAST((2 * upto - size) * 40 // (2 * total) AS INTEGER)) AS shard FROM ordered
), steps AS (
  -- one step of the checksum for each value of a byte: eight halvings of the polynomial division
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), bytes AS (
  SELECT doc_id, key, list_transform(range(length(body) // 2), lambda i: CAST(('0x' || substr(body, 2 * i + 1, 2)) AS BIGINT)) AS b FROM sized
), checked AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, steps
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN checked USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM listed
), sizes AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * met >= 75 * (s.n + t.n - met)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

REPEATS = """
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM coded)
), late AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), marked AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM late
), numbered AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN coded USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM coded LEFT JOIN cut USING (doc_id)
"""

TRIE = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL
), seqs AS (
  SELECT conv_id, list(t ORDER BY r) AS s FROM turns GROUP BY conv_id
), steps AS (
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), digits AS (
  SELECT conv_id, s, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM seqs
), planned AS (
  SELECT conv_id, s, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS BIGINT) AS h FROM digits, steps
), built AS (
  SELECT c.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.s, [])[1:h] ELSE [] END, c.s[h + 1:]) AS s FROM planned c LEFT JOIN seqs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, len(s) AS n, s[d].text AS last, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS deepest, any_value(last) AS last, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM prefixes GROUP BY p, d
), valued AS (
  SELECT *, CAST(deepest = d AS BIGINT) AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(last, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saves FROM nodes
), up AS (
  SELECT u.conv_id, u.d, u.leaf, u.saves, a.p AS above, a.d AS depth FROM valued u JOIN prefixes a ON a.conv_id = u.conv_id AND a.d <= u.d
), sums AS (
  SELECT above AS p, depth AS d, sum(leaf) AS n_leaves, sum(saves) AS saved, count(*) FILTER (d = depth + 1) AS kids FROM up GROUP BY above, depth
)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, kids AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s ON s.p = v.p AND s.d = v.d LEFT JOIN prefixes x ON x.conv_id = v.conv_id AND x.d = v.d - 1 LEFT JOIN nodes o ON o.p = x.p AND o.d = x.d
"""
