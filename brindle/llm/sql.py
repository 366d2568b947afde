"""SQL for DuckDB that gives the same rows, for the operators that SQL can express."""

LINKED = """
WITH RECURSIVE {nodes},
{links},
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

OP1 = (
    LINKED.format(
        nodes="""
texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1)""",
        links="""
links AS (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN sizes s ON s.doc_id = c.a JOIN sizes t ON t.doc_id = c.b WHERE 10 * c.n >= 8 * (s.n + t.n - c.n))""",
    )
    + """
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
  (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links FROM documents d
"""
)

OP3 = """
WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
spans AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM parts)),
twice AS (SELECT r, g FROM spans GROUP BY 1, 2 HAVING count(*) > 1),
places AS (SELECT DISTINCT s.r, unnest(range(s.i, s.i + 8)) AS p FROM spans s JOIN twice USING (r, g)),
covered AS (SELECT r, count(*) AS n FROM places GROUP BY 1),
base AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS f2, 100 * n_dup_lines > 30 * n_lines AS f3 FROM base),
hosts AS (SELECT source, count(*) AS n, unnest([sum(base_failed::INT), sum(f2::INT), sum(f3::INT)]) AS f, unnest([1, 2, 3]) AS rule FROM failed WHERE source IS NOT NULL GROUP BY source),
fitted AS (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2) AS v, (count(*) - 1) / sum(n) AS chance, 1 - sum(n * n) / (sum(n) * sum(n)) AS spread FROM hosts GROUP BY rule),
differ AS (SELECT rule, m, CASE WHEN spread > 1e-9 THEN (v - m * (1 - m) * chance) / spread END AS d FROM fitted),
prior AS (SELECT rule, m, greatest(1.0, least(1e6, CASE WHEN d > 1e-9 THEN m * (1 - m) / d - 1 ELSE 1e6 END)) AS s FROM differ),
rates AS (SELECT source, rule, m, s, n, (f + m * s) / (n + s) AS rate FROM hosts JOIN prior USING (rule)),
bad AS (SELECT DISTINCT source FROM rates WHERE rate - 2.0 * sqrt(rate * (1 - rate) / (n + s + 1)) > greatest(0.2, 2.0 * m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM failed LEFT JOIN bad ON failed.source = bad.source
"""

OP5 = (
    LINKED.format(
        nodes="""
units AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)""",
        links="""
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y ON x.vec_id <> y.vec_id WHERE list_inner_product(x.u, y.u) >= 0.95)""",
    )
    + """
, named AS (SELECT d.vec_id, least(d.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = d.vec_id), d.vec_id)) AS component_id,
  (SELECT count(*) FROM links l WHERE l.a = d.vec_id) AS n_links FROM embeddings d)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named
"""
)

OP7 = """
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
keyed AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(/index)?(\\.html?)?/?\\z', '') END AS k,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM named),
listed AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING min(url) <> max(url))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM keyed
"""

OP9 = """
WITH held AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
digests AS (SELECT page_id, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest FROM held),
owners AS (SELECT payload_digest, max(page_id) AS owner FROM digests WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to FROM digests LEFT JOIN owners USING (payload_digest)
"""

#: A run of at least six words and four periods agrees with itself over five words or more: places and periods come from equal stretches of five.
OP11 = """
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS o,
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS BIGINT), 1)) AS BIGINT)) AS digits FROM documents),
hashed AS (SELECT r, o, CAST(len(o) AS BIGINT) AS n, doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), digits), lambda acc, b:
    list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)))), CAST(4294967295 AS BIGINT)) AS h FROM cut),
turned AS (SELECT r, doc_id, o, n, h % 10 = 0 AND n > 0 AS turn, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
texts AS (SELECT r, doc_id, n, CASE WHEN turn THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM turned),
grams AS (SELECT r, n, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, n, w, unnest(range(n - 4)) AS i FROM texts WHERE n >= 6)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, min(i) AS start, max(i) + 5 - min(i) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
summary AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
flat AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
stay AS (SELECT f.r, string_agg(word, ' ' ORDER BY f.i) AS body FROM flat f LEFT JOIN gone g ON g.r = f.r AND g.i = f.i WHERE g.r IS NULL GROUP BY f.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts t LEFT JOIN summary s ON s.r = t.r LEFT JOIN best b ON b.r = t.r LEFT JOIN stay ON stay.r = t.r
"""

#: Terms as runs of what is no separator; the terms of documents are counted for items' terms only.
OP12 = """
WITH fold AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM fold),
flat AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM fold),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term),
gains AS (SELECT r, doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) AS gain FROM held h JOIN weights USING (term), totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM gains JOIN wanted USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP13 = """
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
judged AS (SELECT r, y.doc_id, line, i, o.k IS NOT NULL AND keeper IS NOT NULL AND keeper IS DISTINCT FROM y.doc_id AS gone FROM keyed y LEFT JOIN owners o ON o.k = y.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r, doc_id
"""
