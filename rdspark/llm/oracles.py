"""Checking SQL of the queries that SQL can express. It names ``documents`` and ``embeddings`` as the given tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Components by the fixpoint of least names over links; documents with equal shingle sets are one node.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS name, s FROM s),
node AS (SELECT name, any_value(s) AS s, any_value(n) AS n FROM named WHERE n > 0 GROUP BY name),
one AS (SELECT name, n, unnest(s) AS g FROM node),
link AS (SELECT a.name AS a, b.name AS b FROM one a JOIN one b ON a.g = b.g AND a.name <> b.name AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.name, b.name, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT name AS a, name AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT r.a AS name, min(d.doc_id) AS component_id FROM reach r JOIN named d ON d.name = r.b AND d.n > 0 GROUP BY r.a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, CASE WHEN d.n > 0 THEN l.component_id ELSE d.doc_id END AS component_id
FROM named d LEFT JOIN least l ON l.name = d.name AND d.n > 0
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, w FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS g FROM p),
late AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM g) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT k + j) AS gone FROM late, range(0, 20) t(j) GROUP BY doc_id),
words AS (SELECT w.doc_id, len(w.w) AS n, coalesce(len(gone), 0) AS removed, unnest(list_concat(w.w, [NULL])) AS word, generate_subscripts(list_concat(w.w, [NULL]), 1) AS k,
          gone FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_words, CAST(max(removed) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (word IS NOT NULL AND NOT coalesce(list_contains(gone, k), false)), '')) AS kept_sha256
FROM words GROUP BY doc_id
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size,
             -ln((CAST('0x' || md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))[1:12] AS BIGINT) + 0.5e0) / 281474976710656e0)
             / CASE WHEN length(text) > 0 THEN greatest(0.05e0, CAST(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS DOUBLE) / length(text)) ELSE 0.05e0 END AS key
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS k, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE level <= ratio) * w, cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
j AS (SELECT d.*, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + floor(greatest(0e0, least(CAST(size AS DOUBLE), rest - start))) AS BIGINT) AS taken FROM j
"""


def _crc32(value: str) -> str:
    """crc32 of a text's bytes, bit by bit."""
    bytes_ = f"list_transform(range(1, octet_length(encode({value})) + 1), lambda i: CAST('0x' || hex(encode({value}))[2 * i - 1:2 * i] AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: {bits}))"


#: The least (cost, audit) by state of the roles' machine, a turn a step: an insert, then the edit of the turn; at the end inserts again.
DIALOGUE = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT k, {_crc32('k')} % 20 AS h FROM (SELECT DISTINCT k FROM o)),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o JOIN h USING (k) WHERE h <> 0),
n AS (SELECT *, row_number() OVER c AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        role[1] || lead(role) OVER c [1] AS pair FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, seen > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM n),
count_ AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
move(i, l, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
add_(i, j, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
edit AS (SELECT conv_id, k, i, i AS j, 2 AS cost, 'D' AS e, '' AS line FROM f, range(4) t(i)
    UNION ALL SELECT conv_id, k, i, j, CASE WHEN cut THEN 5 ELSE 0 END, 'K', role || ':' || text FROM f JOIN move ON l = role[1] WHERE NOT blank AND NOT again
    UNION ALL SELECT conv_id, k, i, j, CASE WHEN cut THEN 6 ELSE 1 END, 'R', CASE l WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text FROM f, move WHERE l <> 's' AND NOT blank AND NOT again),
step AS (SELECT conv_id, k, a.i, edit.j, a.cost + edit.cost AS cost, a.audit || e AS audit, CASE a.audit WHEN '' THEN [] WHEN 'I' THEN [CASE a.j WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE ['user:', 'assistant:'] END
        || CASE e WHEN 'D' THEN [] ELSE [line] END AS lines FROM edit JOIN add_ a ON a.j = edit.i),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS j, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM count_
    UNION ALL SELECT conv_id, k, j, b.cost, b.audit, b.lines FROM (
        SELECT w.conv_id, s.k, s.j, min({{'cost': w.cost + s.cost, 'audit': w.audit || s.audit, 'lines': w.lines || s.lines}}) AS b
        FROM walk w JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.k = w.k + 1 AND s.i = w.j GROUP BY w.conv_id, s.k, s.j)),
last_ AS (SELECT w.conv_id, min({{'cost': w.cost + a.cost, 'audit': w.audit || a.audit, 'lines': w.lines || CASE a.audit WHEN '' THEN [] WHEN 'I' THEN [CASE a.j WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE ['user:', 'assistant:'] END}}) AS b
        FROM walk w JOIN count_ c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k JOIN add_ a ON a.i = w.j AND a.j IN (0, 3) GROUP BY w.conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN count_ c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN last_ l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
"""

SPELLING = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOW}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS n, id || ':' || run AS v FROM r WHERE length(run) >= 6 GROUP BY id, run),
h AS (SELECT run, n, {_crc32('v')} AS h FROM k),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
g AS (SELECT word, n, word[1:i - 1] AS a, word[i + 1:] AS z FROM c),
near AS (SELECT x.word, y.word AS other, y.n FROM g x JOIN g y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
   UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.a || g.z UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.a || g.z),
best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'other': other}}) AS b FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * w.n THEN b.other END AS form, CASE WHEN -b.n >= 5 * w.n THEN -b.n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS root, 1 AS k FROM form WHERE form IS NOT NULL UNION ALL SELECT v.word, f.form, k + 1 FROM walk v JOIN form f ON f.word = v.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM form f LEFT JOIN (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word) e USING (word)
"""

ORACLE_SQL = {"op5_top_k": TOP_K, "op7_jaccard_join": JACCARD, "op8_substring_dedup": SUBSTRINGS, "op9_mixing": MIXING, "op12_conversation_repair": DIALOGUE, "op13_spelling": SPELLING}
