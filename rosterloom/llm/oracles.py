"""The queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
), steps AS (
    SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY n) AS before,
           lead(n) OVER (PARTITION BY conv_id ORDER BY n) IS NULL AS last,
           length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10)) + length(regexp_replace(text,
             '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>|\\',
             'xx', 'g')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                            WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE FALSE END
                AND (NOT last OR role = 'assistant')) AS valid
FROM steps GROUP BY conv_id
"""

VECTORS = """
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), roots AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(root, v.vec_id)) AS component_id,
       least(v.vec_id, coalesce(root, v.vec_id)) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degrees USING (vec_id) LEFT JOIN roots USING (vec_id)
"""

PAGES = r"""
WITH split AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), named AS (
    SELECT *, string_split(host, '.') AS parts, array_to_string(parts[-2:], '.') AS two,
           two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') AS twin,
           CASE WHEN twin THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
           CASE WHEN twin THEN two ELSE parts[-1] END AS suffix
    FROM split
), hosts AS (
    SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n,
           CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS bad
    FROM named JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY ALL
), overall AS (
    SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m,
           coalesce(sum(n), 0) + 1.0::DOUBLE AS worth FROM hosts
), s0 AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m, any_value(worth) AS known FROM hosts, overall GROUP BY suffix
), sk AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 1e-3), 0.5) - 1 AS k FROM s0
), s1 AS (SELECT suffix, 1 / (1 / k + 1 / known) AS k0, (k0 * m + bad) / (k0 + n) AS mean, k0 + n AS worth FROM s0, sk
), d0 AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS m, any_value(worth) AS known
    FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix
), dk AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 1e-3), 0.5) - 1 AS k FROM d0
), d1 AS (SELECT domain, 1 / (1 / k + 1 / known) AS k0, (k0 * m + bad) / (k0 + n) AS mean, k0 + n AS worth FROM d0, dk
), h0 AS (SELECT host, n, bad, mean AS m FROM hosts JOIN d1 USING (domain)
), hk AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.5), 1e-3), 0.5) - 1 AS k FROM h0
), beta AS (
    SELECT page_id, named.host, path, coalesce(d1.mean, s1.mean, overall.m) AS mh,
           coalesce(s1.worth, 1 / (1 / sk.k + 1 / overall.worth)) AS of_suffix,
           coalesce(d1.worth, 1 / (1 / dk.k + 1 / of_suffix)) AS of_domain, 1 / (1 / hk.k + 1 / of_domain) AS kh,
           kh * mh + coalesce(h0.bad, 0) AS a, kh * (1 - mh) + coalesce(h0.n, 0) - coalesce(h0.bad, 0) AS b
    FROM named LEFT JOIN s1 USING (suffix) LEFT JOIN d1 USING (domain) LEFT JOIN h0 ON h0.host = named.host,
         overall, sk, dk, hk
), ruled AS (
    SELECT *, '.' || host AS dotted,
           CASE WHEN dotted LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                WHEN dotted LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                WHEN dotted LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN dotted LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                WHEN dotted LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
    FROM beta
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, row_number() OVER w AS n,
           (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * (sum(source_size) OVER w - source_size))
           / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level
    FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), final AS (
    SELECT coalesce(min_by(level, n), 0) AS level FROM levels WHERE 2.0::DOUBLE * source_size > level * weight
), targets AS (
    SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size <= weight * final.level THEN 2.0::DOUBLE * source_size
                                     ELSE weight * final.level END AS target
    FROM sources, final
), rates AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           CAST(CAST('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS UBIGINT) AS DOUBLE)
           / 4503599627370496 AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

NEGATIVES = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT * FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""

REPAIR = r"""
WITH RECURSIVE places AS (
    SELECT [list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR k IN range(256)] AS crc
), fates AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split(
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
               lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS fate
    FROM conversations, places
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM fates WHERE fate <> 0
), numbered AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, E' \t\n\x0B\x0C\r') AS bare,
           row_number() OVER w AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
           lag(left(role, 1)) OVER w || left(role, 1) AS pair
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(length(role), ':', role, text)), copy)
), turns AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n_turns,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id
), inserts AS (  -- from a state, so many inserted turns: the state then, and what they add
    SELECT * FROM (VALUES ('', 0, '', ''), ('', 1, 'u', E'user:\n'), ('', 2, 'a', E'user:\nassistant:\n'),
        ('s', 0, 's', ''), ('s', 1, 'u', E'user:\n'), ('s', 2, 'a', E'user:\nassistant:\n'),
        ('u', 0, 'u', ''), ('u', 1, 'a', E'assistant:\n'), ('u', 2, 'u', E'assistant:\nuser:\n'),
        ('a', 0, 'a', ''), ('a', 1, 'u', E'user:\n'), ('a', 2, 'a', E'user:\nassistant:\n')) AS t(old, k, mid, added)
), walk AS (
    SELECT conv_id, 0::BIGINT AS n, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS written FROM faults
    UNION ALL
    SELECT conv_id, n, state, cost, audit, written FROM (
        SELECT w.conv_id, w.n + 1 AS n, e.state, w.cost + 2 * k + e.cost AS cost,
               w.audit || repeat('I', CAST(k AS BIGINT)) || e.edit AS audit, w.written || added || e.line AS written
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1
        JOIN inserts i ON i.old = w.state,
        LATERAL (SELECT 'D' AS edit, mid AS state, 3 AS cost, '' AS line
                 UNION ALL SELECT 'K', initial, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, role || ':' || text || chr(10)
                 WHERE fault NOT IN ('blank', 'duplicate')
                   AND (mid = '' AND initial IN ('s', 'u') OR mid || initial IN ('su', 'ua', 'au'))
                 UNION ALL SELECT 'R', CASE mid WHEN 'u' THEN 'a' ELSE 'u' END,
                                  2 + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END,
                                  CASE mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text || chr(10)
                 WHERE fault NOT IN ('blank', 'duplicate')) e
        QUALIFY row_number() OVER (PARTITION BY w.conv_id, w.n, e.state ORDER BY w.cost + 2 * k + e.cost,
            w.audit || repeat('I', CAST(k AS BIGINT)) || e.edit) = 1)
), ends AS (
    SELECT w.conv_id, cost + 2 * k AS cost, audit || repeat('I', CAST(k AS BIGINT)) AS audit, written || added AS written
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n_turns = w.n
    JOIN inserts i ON i.old = w.state AND i.mid IN ('', 'a')
    QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + 2 * k, audit || repeat('I', CAST(k AS BIGINT))) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(left(written, length(written) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), kept AS (SELECT payload, max(page_id) AS page_id, count(*) AS copies FROM payloads GROUP BY payload)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN n >= 1000 AND p.page_id <> k.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND p.page_id <> k.page_id THEN k.page_id END AS refers_to
FROM payloads p JOIN kept k ON p.payload = k.payload
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT, "op5_embedding_near_dedup": VECTORS, "op7_url_filters": PAGES,
            "op10_mixing": MIXING, "op11_hard_negatives": NEGATIVES, "op12_conversation_repair": REPAIR, "op13_warc": WARC}
