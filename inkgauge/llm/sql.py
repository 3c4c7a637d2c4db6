"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .chat_format import ATTACHMENT_TYPES, EXTRA_ID, EXTRA_TEXT, LOSS_ROLE, TURN_CLOSE, TURN_OPEN
from .common import ASCII_LOWER, ASCII_UPPER
from .url_reputation import MIN_GOOD, Z

LOWER = f"'{ASCII_UPPER}', '{ASCII_LOWER}'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {LOWER}) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(kind, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(kind, length(h || pre)) AS kind
  FROM (SELECT DISTINCT page_id, host, path FROM p)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id),
known AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS good FROM labels
          WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k,
            array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
            string_split(host, '.')[-1] AS suffix
          FROM p JOIN known ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
levels AS (SELECT 'host' AS lvl, n, k FROM hosts UNION ALL SELECT 'domain', n, k FROM domains
           UNION ALL SELECT 'suffix', n, k FROM suffixes),
moments AS (SELECT lvl, sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS m, sum(n * n) AS nn, sum(k * k / n) AS kk
            FROM levels GROUP BY lvl),
spread AS (SELECT lvl, mean, mean * (1 - mean) AS inside,
             CASE WHEN n - nn / n = 0 THEN NULL
                  ELSE ((kk - n * mean * mean) - (m - 1) * mean * (1 - mean)) / (n - nn / n) END AS across
           FROM moments),
prior AS (SELECT lvl, mean, least(greatest(CASE WHEN across > 0 AND inside > across THEN inside / across - 1
                 WHEN across > 0 THEN 1.0 ELSE 1000.0 END, 1.0), 1000.0) AS w FROM spread),
s AS (SELECT suffix, (k + w * mean) / (n + w) AS rate FROM suffixes, prior WHERE lvl = 'suffix'),
d AS (SELECT domain, (k + w * rate) / (n + w) AS rate FROM domains JOIN s USING (suffix), prior WHERE lvl = 'domain'),
total AS (SELECT coalesce(sum(k), 0) AS k, coalesce(sum(n), 0) AS n FROM hosts),
-- every host of the pages: without labels it takes its domain's rate, else its suffix's, else that of all labelled pages
every AS (SELECT DISTINCT p.host, coalesce(hosts.n, 0) AS n, coalesce(hosts.k, 0) AS k,
            array_to_string(list_slice(string_split(p.host, '.'), -2, -1), '.') AS domain, string_split(p.host, '.')[-1] AS suffix
          FROM p LEFT JOIN hosts ON p.host = hosts.host),
near AS (SELECT every.*, coalesce(d.rate, s.rate) AS rate FROM every LEFT JOIN d ON every.domain = d.domain
         LEFT JOIN s ON every.suffix = s.suffix),
h AS (SELECT host, near.k + v * r AS a, near.n - near.k + v * (1 - r) AS b
      FROM (SELECT near.*, coalesce(near.rate, (total.k + 1) / (total.n + 2)) AS r,
                   CASE WHEN near.rate IS NULL THEN least(w, total.n + 2) ELSE w END AS v
            FROM near, total, prior WHERE lvl = 'host') near),
bound AS (SELECT host, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h)
SELECT p.page_id, p.host, p.path, rule,
       coalesce(kind, CASE WHEN coalesce(upper, 1.0) < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN bound USING (host)
"""

OP5 = f"""
WITH l AS (
  SELECT doc_id, unnest(list_zip(parts, range(len(parts)))) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT doc_id, x[1] AS line, x[2] AS pos, translate(trim(x[1], {BLANKS}), {LOWER}) AS key FROM l),
common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key
           HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, pos, last IS NOT NULL AND doc_id < last AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[\\x20\\x09-\\x0D]+'),
             lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[\\x20\\x09-\\x0D]+'),
             lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
si AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

CONTROL = "<(/?turn|" + "|".join(ATTACHMENT_TYPES) + ")"
#: Code points that escapes add to a text: one for each backslash and control string, one more per ``>`` of a role.
OP11 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT {EXTRA_ID}, 1, '{LOSS_ROLE}', '{EXTRA_TEXT}'),
l AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{CONTROL}'))
        + length(role) + length(role) - length(replace(role, chr(92), '')) + len(regexp_extract_all(role, '{CONTROL}'))
        + length(role) - length(replace(role, '>', '')) + {len(TURN_OPEN) + 1 + len(TURN_CLOSE)} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

OP12 = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, uid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, uid))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, uid) <= 5
"""

OP13 = """
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY ALL),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels
          WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, coalesce(lang, '') AS part, t, first,
        list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM (SELECT *, coalesce(text, '') AS t FROM documents) d JOIN first USING (t) LEFT JOIN known USING (doc_id)),
f AS (SELECT part, good, toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
        'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
        'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails FROM d),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS l, substr(filter_order, 1, s - 1) AS earlier
          FROM o, (SELECT unnest(range(1, 6))::INTEGER AS s)),
hit AS (
  SELECT part, filter_order, step, l, n, good, toxic, CASE l WHEN 'A' THEN fails['A'] WHEN 'B' THEN fails['B'] WHEN 'C' THEN fails['C'] WHEN 'D' THEN fails['D'] ELSE fails['E'] END AS fail,
    (contains(earlier, 'A') AND fails['A']) OR (contains(earlier, 'B') AND fails['B']) OR (contains(earlier, 'C') AND fails['C'])
      OR (contains(earlier, 'D') AND fails['D']) OR (contains(earlier, 'E') AND fails['E']) AS gone,
    fails['A']::INT + fails['B']::INT + fails['C']::INT + fails['D']::INT + fails['E']::INT AS n_fails
  FROM g, steps),
a AS (SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM hit GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM a
"""

SQL = {"op11_chat_format": OP11, "op12_hard_negatives": OP12, "op13_filter_audit": OP13, "op4_url_reputation": OP4, "op5_line_dedup": OP5, "op7_decontamination": OP7}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
