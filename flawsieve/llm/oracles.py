"""The same results in DuckDB's SQL, where it can express them."""

OP2 = r"""
WITH urls AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (
  SELECT u.page_id, max(k.bad) AS bad FROM urls u
  JOIN known k ON k.doc_id = try_cast(regexp_extract(u.path, '/(\d{1,18})(?:[/.]|$)', 1) AS BIGINT)
  GROUP BY u.page_id),
seen AS (
  SELECT u.host, count(*) AS n, sum(o.bad) AS bad FROM urls u JOIN outcomes o USING (page_id) GROUP BY u.host),
parts AS (
  SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM urls)),
ends AS (
  SELECT host, CASE WHEN length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
    THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix, l FROM parts),
hosts AS (
  SELECT e.host, e.suffix,
    coalesce(nullif(array_to_string(CASE WHEN contains(suffix, '.') THEN l[-3:] ELSE l[-2:] END, '.'), ''), host) AS domain,
    coalesce(s.n, 0) AS n, coalesce(s.bad, 0) AS bad
  FROM ends e LEFT JOIN seen s USING (host)),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad,
    (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS mean FROM hosts GROUP BY suffix),
s1 AS (
  SELECT *, (SELECT greatest(1, least(1000, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000 END, 1000))) FROM (
    SELECT (sum(n * pow(bad / n - mean, 2)) / sum(n) - sum(mean * (1 - mean)) / sum(n))
      / nullif(sum(n * mean * (1 - mean)) / sum(n), 0) AS rho FROM suffixes WHERE n > 0)) AS s FROM suffixes),
d0 AS (
  SELECT d.domain, d.n, d.bad, (s * mean + s1.bad) / (s + s1.n) AS mean
  FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix) d
  JOIN s1 USING (suffix)),
d1 AS (
  SELECT *, (SELECT greatest(1, least(1000, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000 END, 1000))) FROM (
    SELECT (sum(n * pow(bad / n - mean, 2)) / sum(n) - sum(mean * (1 - mean)) / sum(n))
      / nullif(sum(n * mean * (1 - mean)) / sum(n), 0) AS rho FROM d0 WHERE n > 0)) AS s FROM d0),
h0 AS (
  SELECT h.host, h.n, h.bad, (s * mean + d1.bad) / (s + d1.n) AS mean FROM hosts h JOIN d1 USING (domain)),
h1 AS (
  SELECT *, (SELECT greatest(1, least(1000, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000 END, 1000))) FROM (
    SELECT (sum(n * pow(bad / n - mean, 2)) / sum(n) - sum(mean * (1 - mean)) / sum(n))
      / nullif(sum(n * mean * (1 - mean)) / sum(n), 0) AS rho FROM h0 WHERE n > 0)) AS s FROM h0),
low AS (
  SELECT host, p - 1.645 * sqrt(p * (1 - p) / (s + n + 1)) AS low
  FROM (SELECT *, (s * mean + bad) / (s + n) AS p FROM h1)),
judged AS (
  SELECT u.page_id, u.host, u.path, low.low,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls u JOIN low USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_LINES = r"""
lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
"""

OP10 = f"""
WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM often)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""

OP12 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
windows AS (
    SELECT r, pos, string_agg(word, ' ') OVER here AS window_words, count(*) OVER here AS n
    FROM w WINDOW here AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
),
repeated AS (SELECT window_words FROM windows WHERE n = 35 GROUP BY window_words HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT r, pos + step AS pos
    FROM windows JOIN repeated USING (window_words), range(35) AS s(step)
    WHERE n = 35
),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
    FROM w ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
