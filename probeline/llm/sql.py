"""DuckDB SQL that states the same results as the queries."""

from __future__ import annotations

QUALITY_RULES_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT k, doc_id, stratum, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls
    FROM d),
g AS (
    SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n >= 2),
cov AS (
    SELECT k, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
    FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
c AS (
    SELECT w.k, doc_id, stratum, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov ON cov.k = w.k),
b AS (
    SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        CASE WHEN n_words > 0 THEN least(10000, (10000 * n_symbols) // (10 * n_words)) ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN least(10000, (10000 * n_dup_lines) // (30 * n_lines)) ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN least(10000, (10000 * n_repeat_words) // (20 * n_words)) ELSE 0 END AS repeats,
        CASE WHEN word_chars > 0 THEN least(10000, (10000 * n_capitals) // (25 * word_chars)) ELSE 0 END AS capitals
    FROM c),
h0 AS (
    SELECT stratum, greatest(symbols, dup_lines, repeats, capitals) AS bin, count(*) AS n FROM b
    WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
ranked AS (
    SELECT stratum, n, row_number() OVER (ORDER BY n DESC, stratum DESC) AS k
    FROM (SELECT stratum, sum(n) AS n FROM h0 GROUP BY ALL)),
own AS (SELECT coalesce(max(k) FILTER (n * ln(0.99) <= ln(0.05 / (k + 1))), 0) AS own FROM ranked),
h AS (
    SELECT CASE WHEN k <= own THEN h0.stratum ELSE '*' END AS stratum, bin, sum(h0.n) AS n
    FROM h0 JOIN ranked ON h0.stratum = ranked.stratum, own GROUP BY ALL),
z AS (SELECT stratum, sum(n) AS n_good FROM h GROUP BY ALL),
t AS (SELECT stratum, bin + 1 AS bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) - n AS r FROM h),
p AS (
    SELECT stratum, bin, r < n_good * 0.01 AND (
        SELECT sum(exp(lgamma(n_good + 1) - lgamma(x + 1) - lgamma(n_good - x + 1)
                       + x * ln(0.01) + (n_good - x) * ln(0.99)))
        FROM unnest(range(0, r::BIGINT + 1)) AS q(x)) <= 0.05 / (SELECT own + 1 FROM own) AS ok
    FROM t JOIN z USING (stratum)),
cut AS (
    SELECT stratum, min(bin) AS cutoff
    FROM p LEFT JOIN (SELECT stratum, max(bin) AS bad FROM p WHERE NOT ok GROUP BY ALL) USING (stratum)
    WHERE bad IS NULL OR bin > bad GROUP BY ALL),
v0 AS (
    SELECT b.*, coalesce(cut.cutoff, (SELECT max(cutoff) FROM cut WHERE stratum = '*')) AS c
    FROM b LEFT JOIN cut ON cut.stratum = b.stratum AND cut.stratum <> '*'),
v AS (
    SELECT *, concat_ws(',', CASE WHEN symbols >= c THEN 'symbols' END, CASE WHEN dup_lines >= c THEN 'dup_lines' END,
        CASE WHEN repeats >= c THEN 'repeats' END, CASE WHEN capitals >= c THEN 'capitals' END) AS failed_rules
    FROM v0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM v
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
big AS (SELECT h, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM p LEFT JOIN big ON big.h = p.h AND p.n >= 1000
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
    SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM g),
p AS (
    SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
    FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)),
o AS (SELECT k, i, p.n, item_id FROM p JOIN g ON g.g = p.g AND g.n = p.n),
w AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS x FROM o) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM o) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON w.k = d.k LEFT JOIN t ON t.k = d.k
"""

SHARDING_SQL = r"""
WITH d AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS h FROM documents),
p AS (
    SELECT doc_id, n, depth, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 31))::INT AS depth)),
b AS (SELECT depth, prefix, count(*) AS r, sum(n) AS s FROM p GROUP BY ALL),
c AS (
    SELECT doc_id, n, p.depth, p.prefix, r, s, row_number() OVER (PARTITION BY doc_id ORDER BY p.depth) AS k
    FROM p JOIN b USING (depth, prefix) WHERE s <= 2097152)
SELECT doc_id, n::BIGINT AS n_bytes, lpad(depth::VARCHAR, 2, '0') || '-' || prefix AS shard, depth::INT AS depth,
    r::BIGINT AS shard_rows, s::BIGINT AS shard_bytes
FROM c WHERE k = 1
"""

SUFFIX_DEDUP_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n,
        hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (
    SELECT k, o, substr(x, 2 * o + 1, 1198) AS y
    FROM (SELECT k, x, unnest(range(0, n - 199, 400)) AS o FROM d WHERE n >= 200)),
w AS (
    SELECT k, o + j AS i, md5(substr(y, 2 * j + 1, 400)) AS g
    FROM (SELECT k, o, y, unnest(range(0, least(400, strlen(y) // 2 - 199))) AS j FROM e)),
r AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
b AS (
    SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 200, true)::INT AS fresh
    FROM w WHERE g IN (SELECT g FROM r)),
s AS (
    SELECT k, min(i) AS low, max(i) + 200 AS high
    FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM b) GROUP BY k, run),
p AS (SELECT k, low, high, coalesce(lag(high) OVER (PARTITION BY k ORDER BY low), 0) AS prior FROM s),
c AS (
    SELECT p.k, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS tail,
        string_agg(substr(x, 2 * prior + 1, 2 * (low - prior)), '' ORDER BY low) AS parts
    FROM p JOIN d ON d.k = p.k GROUP BY p.k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(parts, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON c.k = d.k
"""
