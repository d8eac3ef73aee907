"""DuckDB SQL for the results that SQL can state."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, o = x.n AND o = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
c AS MATERIALIZED (SELECT doc_id, least(doc_id, min(e.b) FILTER (e.same)) AS cls FROM n LEFT JOIN e ON e.a = doc_id GROUP BY doc_id),
k AS (SELECT e.a AS doc_id, count(DISTINCT c.cls) AS n_links FROM e JOIN c ON c.doc_id = e.b WHERE NOT e.same GROUP BY e.a),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, coalesce(any_value(k.n_links), 0)::BIGINT AS n_links FROM r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN k ON k.doc_id = r.doc_id GROUP BY r.doc_id"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
m AS MATERIALIZED (SELECT doc_id, k, n, item_id FROM g JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
q AS MATERIALIZED (SELECT row_number() OVER () AS q, g, terms, len(terms) AS n FROM (SELECT DISTINCT g, list_distinct(string_split(g, ' ')) AS terms FROM win)),
u AS MATERIALIZED (SELECT q, n, unnest(terms) AS term FROM q),
x AS MATERIALIZED (SELECT doc_id, p, term FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d)),
v AS MATERIALIZED (SELECT doc_id, q FROM (SELECT DISTINCT doc_id, term FROM x) JOIN u USING (term) GROUP BY doc_id, q, n HAVING count(*) = n),
o AS MATERIALIZED (SELECT doc_id, q, n, p, x.term FROM v JOIN u USING (q) JOIN x USING (doc_id, term)),
c AS (SELECT a.doc_id, a.p AS low, max(b.p) AS high FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.q = b.q AND b.p BETWEEN a.p AND a.p + 13 GROUP BY a.doc_id, a.q, a.p, a.n HAVING count(DISTINCT b.term) = a.n),
r AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM (SELECT doc_id, unnest(range(low, high + 1)) AS p FROM c) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)"""

OP9 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
c AS (SELECT *, (i = n OR (h + 31 * coalesce(lag(h) OVER o, 0)) % 3 = 0)::INT AS cut FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM c),
ch AS MATERIALIZED (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines FROM k GROUP BY doc_id, no),
m AS (SELECT *, lines > 1 AND row_number() OVER (PARTITION BY chunk, lines > 1 ORDER BY doc_id, no) > 1 AS gone FROM ch),
a AS (SELECT doc_id, sum(lines)::BIGINT AS n, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS g, coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS n_lines, coalesce(g, 0) AS n_removed, CASE WHEN coalesce(g, 0) = 0 THEN text ELSE kept END AS text FROM documents d LEFT JOIN a USING (doc_id)"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
