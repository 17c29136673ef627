"""DuckDB twins of the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows of 50 bytes as hexadecimal text, taken from parts of 500 windows, as substr counts from the start; a byte goes if its window's least document is a smaller one.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
 part AS (SELECT doc_id, n_bytes, q, substr(h, 2 * q + 1, 1098) AS h FROM (SELECT doc_id, h, n_bytes, unnest(range(0, greatest(0, n_bytes - 49), 500)) AS q FROM n)),
 w AS (SELECT doc_id, q + i AS p, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, q, unnest(range(0, least(500, n_bytes - 49 - q))) AS i FROM part)),
 least AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
 hit AS (SELECT w.doc_id, w.p FROM w JOIN least USING (g) WHERE least.m < w.doc_id),
 cut AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM cut),
 span AS (SELECT doc_id, i, min(p) AS a, max(p) + 50 AS b FROM isle GROUP BY doc_id, i),
 gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
 piece AS (SELECT g.doc_id, string_agg(substr(n.h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM gap g JOIN n USING (doc_id) GROUP BY g.doc_id)
SELECT n.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN piece.doc_id IS NULL THEN n.h ELSE head || substr(n.h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM n LEFT JOIN piece ON piece.doc_id = n.doc_id
"""

#: Sets of shingles, pairs by what they share, the least document reachable.
OP4 = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM t),
 x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS v FROM s),
 pair AS (SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
 both_ways AS (SELECT p, q FROM pair UNION ALL SELECT q, p FROM pair),
 reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.q FROM reach r JOIN both_ways e ON e.p = r.b),
 comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""

_HOST = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}')"
_PATH = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN {_HOST(u)} || {_PATH(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\\??[^#]*)', 1) END"
_FITS = "(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"

#: Rules, then verdicts carried over links between pages by recursion. Links
#: are those with a scheme; the tables have no others.
OP9 = f"""
WITH RECURSIVE rules(host, path, allow) AS (VALUES ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)),
 bare AS (SELECT url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
 tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM bare),
 link AS (SELECT url AS src, CASE WHEN regexp_matches(tag, '(?i)^<link\\b') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
   WHEN regexp_matches(tag, '(?i)^<meta\\b') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS dst FROM tag),
 edge AS (SELECT DISTINCT {_NODE("src")} AS a, {_NODE("dst")} AS b FROM link WHERE regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://')),
 both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
 reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
 p AS (SELECT page_id, {_HOST("url")} AS host, {_PATH("url")} AS path, {_NODE("url")} AS node FROM pages),
 nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '(?s)^([^/?]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
 own AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.allow, length(r.host || r.path)) AS allow FROM p JOIN rules r ON {_FITS} GROUP BY p.page_id),
 judged AS (SELECT p.node, arg_max(r.allow, length(r.host || r.path)) AS allow FROM nodes p JOIN rules r ON {_FITS} GROUP BY p.node),
 alias AS (SELECT reach.a AS node, bool_or(allow) AS good, bool_or(NOT allow) AS bad FROM reach JOIN judged ON judged.node = reach.b GROUP BY reach.a)
SELECT p.page_id, p.host, p.path, own.rule, CASE WHEN own.allow THEN 'allow' WHEN NOT own.allow THEN 'block' WHEN alias.good THEN 'allow' WHEN alias.bad THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN own USING (page_id) LEFT JOIN alias ON alias.node = p.node
"""

#: Failed filters as letters; documents of like failures and labels are counted before they meet the orders.
OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 least AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least.m THEN 'E' ELSE '' END AS bad
  FROM d JOIN least USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
 g AS (SELECT part, good, toxic, bad, count(*) AS n FROM f GROUP BY ALL),
 a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p JOIN a q ON q.x <> p.x JOIN a r ON r.x NOT IN (p.x, q.x) JOIN a s ON s.x NOT IN (p.x, q.x, r.x) JOIN a t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
 c AS (SELECT *, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before, substr(filter_order, 1, step) AS upto FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
 s AS (SELECT part, filter_order, step, filter, sum(CASE WHEN translate(upto, bad, '') = upto THEN n ELSE 0 END) AS kept,
   sum(CASE WHEN contains(bad, filter) AND translate(before, bad, '') = before THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN contains(bad, filter) AND translate(before, bad, '') <> before THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN bad = filter THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN contains(bad, filter) AND translate(before, bad, '') = before THEN n * good ELSE 0 END) AS good_lost,
   sum(CASE WHEN contains(bad, filter) AND translate(before, bad, '') = before THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM g, c GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s
"""

#: All phrases of one to five words, their cuts in 128 bits, longer ones that hold them.
OP12 = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
 n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
 s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
 x AS (SELECT *, unnest(range(1, k)) AS j FROM c),
 y AS (SELECT x.lang, x.k, x.phrase, x.a, x.j, f.a AS l, r.a AS r, n.n, (1000 * x.a * n.n) // (f.a * r.a) AS score FROM x JOIN n USING (lang)
  JOIN g f ON f.lang = x.lang AND f.phrase = array_to_string(x.w[1:x.j], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:x.k], ' ')),
 b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 m AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
