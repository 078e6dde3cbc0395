"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

# Links by counting common shingles, components by walking the links from every document.
SQL["op2_ngram_jaccard"] = r"""
WITH RECURSIVE
lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
split AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM lowered),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i+4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.root, links.y FROM reach JOIN links ON links.x = reach.node)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(root) FROM reach WHERE node = doc_id) AS component_id FROM sets"""

# Every group has every kept term of its language, absent ones with count 0.
SQL["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
seen AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM groups JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM seen GROUP BY lang, term),
p AS (SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS HUGEINT) AS p
      FROM dense JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS HUGEINT) AS q
      FROM whole JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST((SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) FROM p x JOIN p y USING (lang, term)
               WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
over AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over)
QUALIFY part = 'pair' OR rank <= 10"""
