"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words are found without a regular expression over bytes: separators become spaces.
_OP2 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace({_LOWER.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '),
                  lambda w: w <> '') AS w FROM documents),
b AS (SELECT DISTINCT cast(item_id AS VARCHAR) AS item, list_filter(string_split(regexp_replace({_LOWER.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '),
                  lambda w: w <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                  lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, g.item FROM dw JOIN g ON g.n = dw.n AND g.win = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, cast(unhex(sha1(body)) AS BIT)::VARCHAR AS bits,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
           + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
           + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

_OP8 = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""

_OP9 = rf"""
WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')")} AS key FROM x),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(regexp_replace({_LOWER.format("coalesce(text, '')")}, '[ \t\n\v\f\r]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
      AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * inter >= 90 * (na + nb - inter)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c ON doc_id = node
"""

_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_OP12 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace({_LOWER.format('text')}, '{_TERMS}', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * s.n) // s.l) AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT item_id, unnest(list_filter(string_split(regexp_replace({_LOWER.format('text')}, '{_TERMS}', ' ', 'g'), ' '), lambda w: w <> '')) AS x FROM benchmark),
q AS (SELECT item_id, x, count(*) AS times FROM i GROUP BY ALL),
v AS (SELECT x, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s WHERE x IN (SELECT x FROM q) GROUP BY x, s.n),
r AS (SELECT item_id, doc_id, CAST(sum(q.times * v.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN v USING (x) JOIN t USING (x) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS l FROM p),
one AS (SELECT lang, x AS a, count(*) AS f FROM (SELECT lang, unnest(l) AS x FROM w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, a, b, count(*) AS f FROM (SELECT lang, unnest(l[1:len(l) - 1]) AS a, unnest(l[2:]) AS b FROM w WHERE len(l) > 1) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, a, b, c, count(*) AS f FROM (SELECT lang, unnest(l[1:len(l) - 2]) AS a, unnest(l[2:len(l) - 1]) AS b, unnest(l[3:]) AS c FROM w WHERE len(l) > 2)
          GROUP BY ALL HAVING count(*) >= 10),
above AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL),
cuts AS (SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a
           JOIN one y ON y.lang = t.lang AND y.a = t.b LEFT JOIN above u ON u.lang = t.lang AND u.a = t.a AND u.b = t.b WHERE u.f IS NULL OR 100 * u.f < 50 * t.f
         UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 1 FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a
           JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
         UNION ALL SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 2 FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b
           JOIN one y ON y.lang = t.lang AND y.a = t.c),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang)
QUALIFY rank <= 2000
"""

SQL = {"op2_decontaminate": _OP2, "op7_warc": _OP7, "op8_near_vectors": _OP8, "op9_line_dedup": _OP9, "op10_jaccard_join": _OP10,
       "op12_ranked_search": _OP12, "op13_collocations": _OP13}
