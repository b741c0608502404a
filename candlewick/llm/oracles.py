"""DuckDB SQL for the queries of this package that SQL can express."""

#: One level of the tree: dealt(parent keys, name) from nodes(parent keys, name, w, cap, budget).
_DEAL = """
{out}_a AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM {nodes}),
{out}_b AS (SELECT *, cap * onward <= (budget - before) * w AS filled FROM {out}_a),
{out} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE ((budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {parent})) * w)
                 // greatest(1, sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {parent})) END AS share FROM {out}_b)"""

MIX = f"""
WITH docs AS (
  SELECT doc_id, CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE 'web' END AS domain,
         lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_words FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_words) AS words, 2 * sum(n_words) AS cap,
                CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS wd, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS wl
         FROM docs GROUP BY ALL),
n1 AS (SELECT domain, any_value(wd) AS w, sum(cap) AS cap, (SELECT CAST(floor(sum(words) * 0.6) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain HAVING sum(cap) > 0),
{_DEAL.format(out="d1", nodes="n1", parent="1", name="domain", keys="domain")},
n2 AS (SELECT l.domain, l.lang, any_value(wl) AS w, sum(cap) AS cap, any_value(d1.share) AS budget FROM leaf l JOIN d1 ON l.domain = d1.domain GROUP BY l.domain, l.lang HAVING sum(cap) > 0),
{_DEAL.format(out="d2", nodes="n2", parent="domain", name="lang", keys="domain, lang")},
n3 AS (SELECT l.domain, l.lang, l.source, 1 AS w, sum(cap) AS cap, any_value(d2.share) AS budget FROM leaf l
       JOIN d2 ON l.domain = d2.domain AND l.lang IS NOT DISTINCT FROM d2.lang GROUP BY l.domain, l.lang, l.source HAVING sum(cap) > 0),
{_DEAL.format(out="d3", nodes="n3", parent="domain, lang", name="source", keys="domain, lang, source")},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN words > 0 THEN least(coalesce(share, 0) // words, 2) ELSE 2 END AS epochs, words, coalesce(share, 0) AS share
         FROM leaf l LEFT JOIN d3 ON l.domain = d3.domain AND l.lang IS NOT DISTINCT FROM d3.lang AND l.source IS NOT DISTINCT FROM d3.source),
keyed AS (SELECT d.*, p.epochs, CASE WHEN p.epochs < 2 THEN p.share - p.epochs * p.words ELSE 0 END AS remains,
                 md5('7:' || CAST(p.epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
          FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, epochs + CASE WHEN remains > 0 AND sum(n_words) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= remains THEN 1 ELSE 0 END AS n_copies FROM keyed)
SELECT doc_id, domain, lang, source, CAST(n_words AS BIGINT) AS n_words, CAST(n_copies AS BIGINT) AS n_copies FROM taken WHERE n_copies > 0
"""

ORACLES: dict[str, str] = {"op9_source_mixing": MIX}

LINES = r"""
WITH l AS (SELECT doc_id, i AS no, string_split(text, chr(10))[i + 1] AS line FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
w AS (SELECT doc_id, no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
s AS (SELECT row_number() OVER (ORDER BY min(doc_id * 1000000 + no)) AS id, ws, len(ws) AS n, min(doc_id * 1000000 + no) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT id, n, unnest(ws) AS w FROM s),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT * FROM (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS p FROM t JOIN f USING (w)) WHERE p <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
g AS (SELECT DISTINCT y FROM c JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
k AS (SELECT place FROM s WHERE id NOT IN (SELECT y FROM g)),
d AS (SELECT doc_id, no, len(ws) > 0 AND doc_id * 1000000 + no NOT IN (SELECT place FROM k) AS gone FROM w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (gone), '') AS dropped FROM d GROUP BY doc_id
"""
ORACLES["op3_line_dedup"] = LINES

ORACLES["op1_warc_chunks"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM q
"""
