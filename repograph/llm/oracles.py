"""DuckDB SQL of the queries that SQL can express."""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

# Words, distinct 3-word shingles, pairs that share one, links, and the least document that links reach.
OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM w
), c AS (
  SELECT doc_id, len(shingles) AS n, hash(list_sort(shingles)) AS h FROM s
), e AS (
  SELECT doc_id, unnest(shingles) AS shingle FROM s
), f AS (
  SELECT shingle FROM e GROUP BY shingle HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM e a JOIN f USING (shingle) JOIN e b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), ways AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id, doc_id AS there FROM documents
  UNION
  SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.there
)
SELECT c.doc_id, c.n AS n_shingles, m.component_id
FROM c JOIN (SELECT doc_id, min(there) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

# Base 32 of SHA-1: every five hex digits are four characters.
OP10 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), b AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 5 * g + 1, 5) AS INTEGER) >> s) & 31), 1)), 'string_agg', '')),
         'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY hex) AS first_id
  FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""

# The strings of all n-grams, and their CRCs byte by byte.
OP11 = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, CAST(b AS UINTEGER) FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), docs AS (
  SELECT doc_id, row_number() OVER () AS row_no, text FROM documents
), words AS (
  SELECT 'd' AS side, row_no AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), grams AS (
  SELECT side, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram
  FROM words
), counted AS MATERIALIZED (
  SELECT side, row_no, gram, count(*) AS n FROM grams GROUP BY ALL
), hexed AS (
  SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)
), bucketed AS MATERIALIZED (
  SELECT gram, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS UINTEGER)),
           lambda c, x: xor(c >> 8, t[1 + CAST(xor(c & 255, x) AS INTEGER)]), CAST(4294967295 AS UINTEGER)), CAST(4294967295 AS UINTEGER)) % 10000 AS bucket
  FROM hexed, crc_table
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted JOIN bucketed USING (gram) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals
), gains AS (
  SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS gain FROM totals, sums
), weighed AS (
  SELECT row_no, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM counted JOIN bucketed USING (gram) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_no
), scored AS (
  SELECT d.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM docs d JOIN words w ON w.row_no = d.row_no LEFT JOIN weighed x ON x.row_no = d.row_no
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words FROM placed
"""

# A run of D is forced, as no row is both D and U; P is the last fitting row from the second U to the row after the last.
OP13 = r"""
WITH o AS (
  SELECT client_id, click_id, ts, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents,
         row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST) AS rn
  FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
), f AS (
  SELECT client_id, rn, click_id, cents, near AND cents < old AND kind <> 'error' AS d, near AND cents > old AND kind <> 'error' AS u,
         near AND kind = 'click' AND cents IS NOT NULL AS p, sum(coalesce(cents, 0)) OVER (PARTITION BY client_id ORDER BY rn) AS upto
  FROM (SELECT *, lag(cents) OVER w AS old, ts - lag(ts) OVER w <= INTERVAL 5 MINUTE AS near FROM o WINDOW w AS (PARTITION BY client_id ORDER BY rn))
), d AS (
  SELECT client_id, rn, max(rn) OVER (PARTITION BY client_id, island) AS last_d
  FROM (SELECT client_id, rn, rn - row_number() OVER (PARTITION BY client_id ORDER BY rn) AS island FROM f WHERE d)
), u AS (
  SELECT client_id, rn, max(rn) OVER (PARTITION BY client_id, island) AS last_u
  FROM (SELECT client_id, rn, rn - row_number() OVER (PARTITION BY client_id ORDER BY rn) AS island FROM f WHERE u)
), v AS (
  SELECT a.client_id, a.rn, a.click_id AS first_id, a.cents, a.upto - a.cents AS before, last_d, last_u
  FROM f a JOIN d ON d.client_id = a.client_id AND d.rn = a.rn + 1 JOIN u ON u.client_id = a.client_id AND u.rn = d.last_d + 1 WHERE a.cents IS NOT NULL
), m AS (
  SELECT v.*, p.rn AS last_rn, p.click_id AS last_id, p.upto, row_number() OVER (PARTITION BY v.client_id, v.rn ORDER BY p.rn DESC) AS best
  FROM v JOIN f p ON p.client_id = v.client_id AND p.rn BETWEEN v.last_d + 2 AND v.last_u + 1 AND p.p AND p.cents >= v.cents
)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY rn) AS match_no, first_id, last_id, last_rn - rn + 1 AS n_rows,
       CAST(upto - before AS BIGINT) AS sum_cents, sha256('A' || repeat('D', last_d - rn) || repeat('U', last_rn - last_d - 1) || 'P') AS labels_sha256
FROM m WHERE best = 1
"""

SQL: dict[str, str] = {"op1_vafile_topk": OP1, "op5_ngram_jaccard_join": OP5, "op10_warc": OP10, "op11_importance_resampling": OP11, "op13_row_patterns": OP13}
