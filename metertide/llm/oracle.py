"""What the queries return, as SQL over the tables, where SQL can say it."""

OP8 = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         2 * source_size AS cap
  FROM by_source
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), sources AS (
  SELECT source, place, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target,
         CAST(ceil(greatest(source_size, 1) / 1048576.0) AS BIGINT) AS shards
  FROM levels
), placed AS (
  SELECT s.*, o.place, o.source_size, o.target,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) % o.shards AS shard
  FROM sizes s JOIN sources o ON s.source IS NOT DISTINCT FROM o.source
), shards AS (
  SELECT place, shard, CAST(sum(size) AS BIGINT) AS shard_size,
         CAST(ceil(sum(size) / 32.0) AS BIGINT) AS blocks
  FROM placed GROUP BY place, shard
), seats AS (
  SELECT CAST(floor(sum(target) / 32 + 0.5) AS BIGINT) AS seats FROM sources
), capacity AS (
  SELECT place, target, 2 * (SELECT sum(blocks) FROM shards h WHERE h.place = o.place) AS cap
  FROM sources o
), per_source AS (
  SELECT place, count(*) AS seats FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS nth
    FROM (SELECT place, target, unnest(range(CAST(cap AS BIGINT))) AS k FROM capacity)
    WHERE target > 0)
  WHERE nth <= (SELECT seats FROM seats) GROUP BY place
), per_shard AS (
  SELECT place, shard, count(*) AS quota FROM (
    SELECT place, shard,
           row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS nth
    FROM (SELECT place, shard, shard_size::DOUBLE AS shard_size, unnest(range(2 * blocks)) AS k FROM shards)
    WHERE shard_size > 0) JOIN per_source USING (place)
  WHERE nth <= seats GROUP BY place, shard
), stream AS (
  SELECT p.*, h.shard_size, greatest(h.blocks, 1) AS blocks, coalesce(q.quota, 0) AS quota,
         CAST('0x' || substr(md5('mix-1|' || p.place || '|' || p.shard), 1, 8) AS BIGINT)
           % greatest(h.blocks, 1) AS start,
         CAST(sum(p.size) OVER (PARTITION BY p.place, p.shard ORDER BY digest, p.doc_id, p.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - p.size AS first
  FROM placed p JOIN shards h USING (place, shard) LEFT JOIN per_shard q USING (place, shard)
), ends AS (
  SELECT *, first + size AS last, quota % blocks AS extra, first // 32 AS i, (first + size) // 32 AS j
  FROM stream
)
SELECT doc_id, size, source_size, target,
       CAST(quota // blocks * size
       + ((j * extra + start) // blocks) * 32
       + (((j + 1) * extra + start) // blocks - (j * extra + start) // blocks) * (last - j * 32)
       - ((i * extra + start) // blocks) * 32
       - (((i + 1) * extra + start) // blocks - (i * extra + start) // blocks) * (first - i * 32)
       AS BIGINT) AS taken
FROM ends
"""

OP9 = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
      THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
      THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed
), hosts AS (
  SELECT host, count(rule) AS n,
         count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS bad,
         array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1),
                         len(string_split(host, '.'))), '.') AS domain,
         string_split(host, '.')[-1] AS suffix
  FROM ruled GROUP BY host
), domains AS (
  SELECT suffix, domain, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM domains GROUP BY ALL
), groups AS (
  SELECT 'host' AS kind, n::DOUBLE AS n, bad::DOUBLE AS bad FROM hosts WHERE n > 0
  UNION ALL SELECT 'domain', n, bad FROM domains WHERE n > 0
  UNION ALL SELECT 'suffix', n, bad FROM suffixes WHERE n > 0
), moments AS (
  SELECT kind, sum(bad) / sum(n) AS mean, sum(n) AS n, count(*) AS k,
         greatest(0, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2) AS spread
  FROM groups GROUP BY kind
), priors AS (
  SELECT kind, mean, least(1000, greatest(1, CASE WHEN spread - mean * (1 - mean) * k / n <= 0 THEN 1000
         ELSE (mean * (1 - mean) - spread) / (spread - mean * (1 - mean) * k / n) END)) AS w
  FROM moments
), m AS (
  SELECT coalesce(max(mean), 0) AS mean, coalesce(max(w) FILTER (kind = 'suffix'), 1) AS ws,
         coalesce(max(w) FILTER (kind = 'domain'), 1) AS wd, coalesce(max(w) FILTER (kind = 'host'), 1) AS wh
  FROM priors
), s AS (
  SELECT suffix, (m.mean * ws + bad) / (n + ws) AS mean, n + ws AS pages FROM suffixes, m
), sv AS (
  SELECT suffix, mean, mean * (1 - mean) / (pages + 1) AS var FROM s
), d AS (
  SELECT suffix, domain, (sv.mean * wd + bad) / (n + wd) AS mean, n + wd AS pages, wd, var
  FROM domains JOIN sv USING (suffix), m
), dv AS (
  SELECT suffix, domain, mean, mean * (1 - mean) / (pages + 1) + (wd / pages) ** 2 * var AS var FROM d
), h AS (
  SELECT host, (dv.mean * wh + bad) / (n + wh) AS mean, n + wh AS pages, wh, var
  FROM hosts JOIN dv USING (suffix, domain), m
), lower AS (
  SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (pages + 1) + (wh / pages) ** 2 * var) AS lower FROM h
)
SELECT page_id, host, path, rule, CASE
         WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
         WHEN rule IS NOT NULL OR lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN lower USING (host)
"""

OP10 = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS numbers
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(numbers) AS x, generate_subscripts(numbers, 1) AS i FROM whole
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

# Texts as hexadecimal digits, two a byte, since SQL cuts strings by character.
OP5 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT id, doc_id, base + i AS p, substr(part, 2 * i + 1, 100) AS s
  FROM (SELECT id, doc_id, base, part, unnest(range(least(128, len(part) // 2 - 49))) AS i
        FROM (SELECT id, doc_id, 128 * b AS base, substr(h, 256 * b + 1, 354) AS part
              FROM (SELECT id, doc_id, h, unnest(range(len(h) // 256 + 1)) AS b FROM texts)))
), firsts AS (
  SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), repeated AS (
  SELECT id, p, coalesce(p > lag(p) OVER (PARTITION BY id ORDER BY p) + 50, true) AS opens
  FROM strings JOIN firsts USING (s) WHERE first < doc_id
), numbered AS (
  SELECT *, count(*) FILTER (opens) OVER (PARTITION BY id ORDER BY p) AS span FROM repeated
), spans AS (
  SELECT id, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY id, span
), cuts AS (
  SELECT id, h, span, a, b, coalesce(lag(b) OVER (PARTITION BY id ORDER BY span), 0) AS before
  FROM spans JOIN texts USING (id)
), kept AS (
  SELECT id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY span)
           || substr(any_value(h), 2 * max(b) + 1) AS h
  FROM cuts GROUP BY id
)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (id)
"""

OP11 = r"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2),
           lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))) END AS s
  FROM words
), classes AS MATERIALIZED (
  SELECT row_number() OVER () AS class, s, len(s) AS n, min(doc_id) AS first_id
  FROM sets WHERE len(s) > 0 GROUP BY s
), items AS MATERIALIZED (
  SELECT class, n, hash(unnest(s)) AS h FROM classes
), linked AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.class AS a, y.class AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared
    FROM items x JOIN items y ON x.h = y.h AND x.class <> y.class AND 100 * x.n >= 85 * y.n
      AND 100 * y.n >= 85 * x.n
    GROUP BY x.class, y.class)
  WHERE 100 * shared >= 85 * (n + m - shared)
), reached AS (
  WITH RECURSIVE r(class, other) AS (
    SELECT class, class FROM classes
    UNION
    SELECT r.class, b FROM r JOIN linked ON r.other = a)
  SELECT r.class, min(first_id) AS component_id FROM r JOIN classes c ON r.other = c.class GROUP BY r.class
)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE component_id END AS component_id
FROM sets t LEFT JOIN classes c ON t.s = c.s LEFT JOIN reached USING (class)
"""


def _op12() -> str:
    """Six rounds and a last assignment, each over the codebooks of the round before."""
    steps = []
    for n in range(7):
        steps.append(f"""away{n} AS MATERIALIZED (
  SELECT id, p, min({{'distance': list_sum(list_transform(range(1, len(v) + 1),
           lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'e': e}}) AS best
  FROM parts JOIN book{n} USING (p) GROUP BY id, p
)""")
        if n < 6:
            steps.append(f"""sums{n} AS (
  SELECT p, e, d, sum(x) AS total, count(*) AS n
  FROM (SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS d
        FROM away{n} JOIN parts USING (id, p)) GROUP BY ALL
), means{n} AS (
  SELECT p, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c
  FROM sums{n} GROUP BY p, e
), book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN means{n} m USING (p, e)
)""")
    return (
        """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS numbers
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT id, p, numbers[p * len(numbers) // 8 + 1:(p + 1) * len(numbers) // 8] AS v
  FROM whole, (SELECT unnest(range(8)) AS p)
), book0 AS MATERIALIZED (
  SELECT p, id - 1 AS e, v AS c FROM parts WHERE id <= 16
), """
        + ", ".join(steps)
        + """, coded AS (
  SELECT id, string_agg(format('{:02x}', best.e), '' ORDER BY p) AS code,
         CAST(sum(best.distance) AS BIGINT) AS error
  FROM away6 GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded JOIN whole USING (id)
"""
    )


ORACLE = {
    "op5_suffix_dedup": OP5,
    "op8_mixing": OP8,
    "op9_url_filter": OP9,
    "op10_top_k": OP10,
    "op11_jaccard_join": OP11,
    "op12_vector_codes": _op12(),
}
