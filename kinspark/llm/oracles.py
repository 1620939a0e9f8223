"""DuckDB statements equal to the queries of this package, where SQL can express them."""

IDENTIFIERS = r"""
squeezed AS (
  SELECT rec_id, regexp_replace(upper(lei), '[^A-Z0-9]+', '', 'g') AS l,
         regexp_replace(upper(wikidata_qid), '[^A-Z0-9]+', '', 'g') AS q
  FROM companies_filtered),
tails AS (SELECT rec_id, right(l, 20) AS l, nullif(regexp_extract(q, 'Q[1-9][0-9]*$'), '') AS q FROM squeezed),
ids AS (
  SELECT rec_id, q,
         CASE WHEN regexp_full_match(l, '[A-Z0-9]{18}[0-9]{2}')
               AND CAST(list_aggregate(list_transform(string_split(l, ''), lambda c:
                   CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), 'string_agg', '') AS HUGEINT) % 97 = 1
              THEN l END AS l
  FROM tails),
marks AS (
  SELECT rec_id, 'L' || l AS v FROM ids WHERE l IS NOT NULL
  UNION ALL SELECT rec_id, 'Q' || q FROM ids WHERE q IS NOT NULL),
hubs AS (SELECT v, min(rec_id) AS hub FROM marks GROUP BY v),
ties AS (SELECT DISTINCT rec_id AS x, hub AS y FROM marks JOIN hubs USING (v)),
sides AS (SELECT x, y FROM ties UNION SELECT y, x FROM ties),
reach(x, y) AS (
  SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
grouped AS (SELECT x AS rec_id, min(y) AS group_id FROM reach GROUP BY x),
sized AS (SELECT rec_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM grouped),
groups AS (SELECT rec_id, group_id FROM sized WHERE n > 1)
"""

P2 = f"WITH RECURSIVE {IDENTIFIERS} SELECT rec_id, group_id FROM groups"

P1 = rf"""WITH RECURSIVE {IDENTIFIERS},
listed AS (
  SELECT rec_id, CASE
    WHEN aliases LIKE '[%' THEN list_transform(regexp_extract_all(aliases, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"'), lambda x: replace(substr(x, 2, length(x) - 2), '\', ''))
    ELSE regexp_split_to_array(aliases, '[|;]') END AS a
  FROM companies_filtered WHERE aliases IS NOT NULL),
counted AS (
  SELECT rec_id, len(list_distinct(list_filter(list_transform(a, lambda x: lower(trim(x))), lambda x:
         x NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', 'unknown', 'pending', '[]')))) AS n FROM listed),
facts AS (
  SELECT g.group_id, g.rec_id, i.l, i.q, coalesce(k.n, 0) AS n, nullif(lower(trim(c.source)), '') AS s,
         row_number() OVER (PARTITION BY g.group_id ORDER BY
           CASE lower(trim(c.source)) WHEN 'gleif' THEN 1 WHEN 'wikidata' THEN 2 WHEN 'asx' THEN 3 WHEN 'lse' THEN 3 WHEN 'tsx' THEN 3 ELSE 4 END,
           c.updated_at DESC NULLS LAST, c.rec_id) AS r
  FROM groups g JOIN companies_filtered c USING (rec_id) JOIN ids i USING (rec_id) LEFT JOIN counted k USING (rec_id))
SELECT group_id, 'source' AS field, arg_min(rec_id, r) AS rec_id FROM facts WHERE s IS NOT NULL GROUP BY group_id
UNION ALL SELECT group_id, 'lei', arg_min(rec_id, r) FROM facts WHERE l IS NOT NULL GROUP BY group_id
UNION ALL SELECT group_id, 'wikidata_qid', arg_min(rec_id, r) FROM facts WHERE q IS NOT NULL GROUP BY group_id
UNION ALL SELECT group_id, 'aliases', first(rec_id ORDER BY n DESC, r) FROM facts WHERE n > 0 GROUP BY group_id
"""

ORACLES = {"p1_found": P1, "p2_found": P2}
