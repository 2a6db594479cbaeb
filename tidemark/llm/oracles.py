"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams))
), hits AS (
  SELECT rid, i, k, item_id FROM windows JOIN grams USING (gram, k)
), counted AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (rid) LEFT JOIN listed USING (rid)
"""

#: host/path of the rules of op8, longest first, and what they say
RULES = (("block", "example.org/en/1"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/"), ("allow", "org/"))


def _fits(text: str) -> str:
    host, _, path = text.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


def _strength(source: str, group: str, mean: str) -> str:
    return f"""SELECT {group}, CASE WHEN icc > 0 AND icc < 1 THEN greatest(1.0, least(1000.0, 1 / icc - 1)) ELSE 1000.0 END AS strength
  FROM (
    SELECT {group}, (sum(n * (bad / n - {mean}) ** 2) - (count(*) - 1) * first({mean}) * (1 - first({mean})))
      / nullif((sum(n) - sum(n * n) / sum(n) - count(*) + 1) * first({mean}) * (1 - first({mean})), 0) AS icc
    FROM {source} WHERE n > 0 GROUP BY {group}
  )"""


OP8 = f"""
WITH placed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS two,
    array_to_string(string_split(host, '.')[-3:], '.') AS three, string_split(host, '.')[-1] AS one
  FROM placed LEFT JOIN known ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1) AS BIGINT) GROUP BY host
), named AS (
  SELECT host, n, bad, CASE WHEN shared THEN two ELSE one END AS suffix, CASE WHEN shared THEN three ELSE two END AS domain
  FROM (SELECT *, two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'example.com', 'example.net', 'example.org') AS shared FROM hosts)
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM domains) AS share, 1 AS everything FROM domains GROUP BY suffix
), s0 AS (
  {_strength("suffixes", "everything", "share")}
), s1 AS (
  SELECT suffix, (bad + coalesce(strength, 1000) * share) / (n + coalesce(strength, 1000)) AS suffix_share FROM suffixes LEFT JOIN s0 USING (everything)
), d1 AS (
  SELECT * FROM domains JOIN s1 USING (suffix)
), s2 AS (
  {_strength("d1", "suffix", "suffix_share")}
), d2 AS (
  SELECT domain, (bad + coalesce(strength, 1000) * suffix_share) / (n + coalesce(strength, 1000)) AS domain_share FROM d1 LEFT JOIN s2 USING (suffix)
), h1 AS (
  SELECT * FROM named JOIN d2 USING (domain)
), s3 AS (
  {_strength("h1", "suffix", "domain_share")}
), posterior AS (
  SELECT host, n + coalesce(strength, 1000) AS size, (bad + coalesce(strength, 1000) * domain_share) / (n + coalesce(strength, 1000)) AS mean
  FROM h1 LEFT JOIN s3 USING (suffix)
), bounds AS (
  SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM posterior
), ruled AS (
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(t)} THEN '{t}'" for _, t in RULES)} END AS rule FROM placed
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in RULES)}
  WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN bounds USING (host)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(v.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.w) = len(v.w)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS bits FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(
      list_transform(range(5), lambda j: get_bit(bits, CAST(5 * i + j AS INTEGER)) * CAST(2 ** (4 - j) AS INTEGER)))::BIGINT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
"""

# A place's number stands for (doc_id, position), the order in which lines are first.
OP3 = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, pos, list_filter(string_split(translate(ls[pos], '123456789' || chr(9) || chr(13) || chr(12) || chr(11), '000000000    '), ' '), lambda x: x <> '') AS t
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM d)
), leaved AS (
  SELECT row_number() OVER (ORDER BY rid, pos) AS line, rid, pos, t, len(t) AS n, CASE WHEN len(t) >= 20 THEN 2 ELSE 3 END AS least,
    list_transform(t[1:4], lambda x: CASE WHEN contains(x, '0') THEN '<*>' ELSE x END) AS head
  FROM l WHERE len(t) >= 5
), each AS (
  SELECT line, n, head, least, j, t[j] AS token FROM (SELECT *, unnest(range(5, n + 1)) AS j FROM leaved)
), constant AS (
  SELECT * FROM each QUALIFY count(*) OVER (PARTITION BY n, head, j, token) >= least
), taking AS (
  SELECT line, n, head, list({'j': j, 'token': token} ORDER BY j) AS parts FROM constant GROUP BY line, n, head HAVING count(*) >= 0.5 * (n - 4)
), firsts AS (
  SELECT n, head, j, token, min(line) AS leader FROM each SEMI JOIN taking USING (line) GROUP BY ALL HAVING count(*) >= first(least)
), following AS (
  SELECT line, leader FROM each SEMI JOIN taking USING (line) JOIN firsts USING (n, head, j, token) GROUP BY line, leader, n HAVING count(*) >= 0.5 * (n - 4)
), lines AS (
  SELECT line, NULL AS leader, n, head, parts FROM taking UNION ALL SELECT line, leader, NULL, NULL, NULL FROM following
), placed AS (
  SELECT lines.*, rid, pos, least FROM lines JOIN (SELECT line, rid, pos, least FROM leaved) USING (line)
), marked AS (
  SELECT rid, pos, least, dense_rank() OVER (ORDER BY leader, n, head, parts) AS template FROM placed
), templates AS (
  SELECT template, min(rid) AS kept FROM marked GROUP BY template HAVING count(DISTINCT rid) >= first(least)
), dropped AS (
  SELECT rid, list(DISTINCT pos) AS gone FROM marked JOIN templates USING (template) WHERE rid <> kept GROUP BY rid
), rest AS (
  SELECT doc_id, coalesce(len(gone), 0) AS n_dropped,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END AS text
  FROM d LEFT JOIN dropped USING (rid)
)
SELECT doc_id, n_dropped, CAST(length(text) AS BIGINT) AS chars_left, md5(text) AS text_md5 FROM rest
"""
