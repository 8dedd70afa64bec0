"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op6_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS s,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM t
), judged AS (
  SELECT doc_id, s, i, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(s, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(s, '[|»›·•→]')) AS bars, len(regexp_extract_all(s, '!!')) AS shouts,
         regexp_matches(s, '[.!?…]["''”’»)\]]*([\x20\x09-\x0D]|$)|[。！？｡．؟۔।॥։።។៕။]') AS ended,
         len(regexp_extract_all(s, '(?i)(released under the|licensed under|all rights reserved|terms of (use|service)|privacy policy|use cookies|cookie policy|enable javascript|click here|sign up|subscribe now|skip to content)')) AS plates
  FROM lines
), line_sums AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT s) FILTER (n > 0) AS n_dup_lines,
         sum(CASE WHEN n > 0 AND (sym * 3 > n OR bars * 4 > n OR shouts * 4 > n OR (n >= 4 AND NOT ended) OR (plates > 0 AND plates * 20 >= n)) THEN 0 ELSE length(s) + 1 END) AS held
  FROM judged GROUP BY doc_id
), base AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(s, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(s) AS size, greatest(held - 1, 0) AS held
  FROM t JOIN line_sums USING (doc_id) LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (size - held) <= 50 * size AS kept
FROM base
"""

ORACLES["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3) + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS LAST) - 1 AS place,
         ('0x' || substr(md5('17:' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, size * 50 > source_size AS large,
         least(2, floor((place + 1) * rate + u) - floor(place * rate + u)) * size AS drawn FROM r
), h AS (
  SELECT source AS s, count(*) AS n_large, sum(size) AS large_size, sum(drawn) AS large_taken FROM g WHERE large GROUP BY source
), j AS (
  SELECT doc_id, size, source_size, target, u, large,
         CASE WHEN large THEN place ELSE place - coalesce(n_large, 0) END AS place,
         CASE WHEN large OR source_size - coalesce(large_size, 0) = 0 THEN rate
              ELSE greatest(0.0::DOUBLE, least(2.0::DOUBLE, (target - coalesce(large_taken, 0)) / (source_size - coalesce(large_size, 0)))) END AS rate
  FROM g LEFT JOIN h ON g.source IS NOT DISTINCT FROM h.s
), q AS (
  SELECT *, least(rate - floor(rate), 1 - (rate - floor(rate))) AS rarer FROM j
), st AS (
  SELECT *, CASE WHEN rarer > 1e-9 THEN greatest(1, round(1 / rarer)) ELSE 1 END::BIGINT AS stretch FROM q
), turned AS (
  SELECT *, CASE WHEN NOT large AND (place // stretch) % 2 = 1 THEN (place // stretch) * stretch + stretch - 1 - place % stretch ELSE place END AS pos FROM st
)
SELECT doc_id, size, source_size, target, (least(2, floor((pos + 1) * rate + u) - floor(pos * rate + u)) * size)::BIGINT AS taken FROM turned
"""

ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first > page_id THEN first END AS refers_to
FROM m
"""

ORACLES["op8_recompression"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) AS g FROM t WHERE len(w) >= 13
), x AS (
  SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM g
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM x) WHERE first < doc_id
), cov AS (
  SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 13)) AS k)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

ORACLES["op2_suffix_dedup"] = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT doc_id, list_transform(range(0, n - 49), lambda i: substr(h, 2 * i + 1, 100)) AS g FROM t WHERE n >= 50
), x AS (
  SELECT doc_id, unnest(g) AS g, unnest(range(0, len(g))) AS s FROM g
), hit AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM x) WHERE first < doc_id
), marked AS (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cut JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
