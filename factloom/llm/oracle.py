"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
m AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN m.first < d.page_id OR (d.page_id IS NULL AND m.first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first < d.page_id OR d.page_id IS NULL THEN m.first END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest
"""

OP3 = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
g AS MATERIALIZED (SELECT r, unnest(s) AS g FROM s WHERE doc_id IS NOT NULL),
p AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
t AS (SELECT r, r AS reached FROM n UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.reached)
SELECT n.doc_id, n.n AS n_shingles, c.component_id
FROM n JOIN (SELECT t.r, min(m.doc_id) AS component_id FROM t JOIN n m ON m.r = t.reached GROUP BY t.r) c ON c.r = n.r
"""

OP4 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS newest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, h.key IS NOT NULL AND h.newest IS DISTINCT FROM k.doc_id AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

OP5 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS MATERIALIZED (
  SELECT source, size, [5, 2, 1][1 + CAST((rank - 1) % 3 AS BIGINT)] AS w FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
t AS (
  SELECT source, size, w, FALSE AS capped, 0 AS round FROM s
  UNION ALL
  SELECT source, size, w, capped OR w * (sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()) > 3 * size * sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), round + 1
  FROM t WHERE round < (SELECT count(*) FROM s)),
f AS (SELECT * FROM t WHERE round = (SELECT count(*) FROM s)),
g AS (
  SELECT source, size AS source_size, CASE WHEN capped THEN CAST(3 * size AS DOUBLE) ELSE
    CAST(w * (sum(size) OVER () - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS INTEGER)) ELSE 0 END AS copies FROM g),
c AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, copies + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END AS n FROM c)
SELECT doc_id, source, size, source_size, target, CAST(n AS INTEGER) AS copies, CAST(n * size AS BIGINT) AS taken FROM e
"""

OP8 = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (
  SELECT t.conv_id, v.perspective, t.turn, t.speaker, t.raw, t.speaker = v.perspective AS own,
         '<|im_start|>' || CASE WHEN t.speaker = v.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(replace(t.speaker, '<|', '< |'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
o AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, raw ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS stop FROM p)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_targets,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, raw) AS text,
       coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY stop) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective
"""

OP10 = f"""
WITH lw AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS key FROM bw WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM k),
q AS (
  SELECT r, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS key,
         unnest(range(1, len(w) - size + 2)) AS i FROM lw, z WHERE len(w) >= size),
m AS MATERIALIZED (SELECT q.r, q.i, q.size, k.item_id FROM q JOIN k ON q.size = k.size AND q.key = k.key),
j AS MATERIALIZED (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + size)) AS j FROM m)),
hit AS (SELECT r, count(*) AS n FROM j GROUP BY r),
runs AS (SELECT r, min(j) AS a, max(j) AS b FROM (SELECT r, j, j - row_number() OVER (PARTITION BY r ORDER BY j) AS run FROM j) GROUP BY r, run),
gaps AS (SELECT r, w, string_split_regex(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS g FROM lw WHERE r IN (SELECT r FROM j)),
places AS (
  SELECT runs.r, coalesce(list_sum(list_transform(g[1:a], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0) AS first,
         coalesce(list_sum(list_transform(g[1:b], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:b], lambda x: length(x))), 0) AS last
  FROM runs JOIN gaps ON runs.r = gaps.r),
spans AS (SELECT r, string_agg(CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY first) AS l FROM places GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM m) GROUP BY r)
SELECT lw.doc_id, CAST(len(lw.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(spans.l, '') AS hit_spans
FROM lw LEFT JOIN hit ON lw.r = hit.r LEFT JOIN items ON lw.r = items.r LEFT JOIN spans ON lw.r = spans.r
"""


def _lloyd(k: int = 8, rounds: int = 10) -> str:
    """One step of SQL for each round: a recursive query could not average within its recursion."""
    out = ["""k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM (
    SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, c.v) + list_dot_product(c.v, c.v), c := c.c)) AS m FROM k, c{i} c GROUP BY r)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k JOIN a{i} ON k.r = a{i}.r) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM s{i})
  UNION ALL SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) FROM s{i} GROUP BY c)""")
    return "WITH " + ",\n".join(out) + f"""
SELECT k.vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM k JOIN a{rounds} ON k.r = a{rounds}.r JOIN c{rounds} c ON c.c = m.c
"""


OP13 = """
WITH g AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM g a JOIN g b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT r, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE alike AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.p ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """Token counts, nearest neighbours, secret spans, languages and fingerprints have none: they are tested against brute force."""
    return {
        "op1_warc": OP1, "op3_ngram_jaccard": OP3, "op4_line_dedup": OP4, "op5_mixing": OP5, "op8_chat": OP8, "op10_decontamination": OP10,
        "op11_delta_lloyd": _lloyd(), "op13_hard_negatives": OP13}
