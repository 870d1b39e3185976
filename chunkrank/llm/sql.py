"""The operators of this round as DuckDB SQL."""

SOURCE_AUDIT = r"""
WITH texts AS (
    SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT place, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT place) >= 10
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), cells AS (
    SELECT DISTINCT lang, source FROM texts
), counted AS (
    SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (
    SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL
), shares AS (
    SELECT cells.lang, cells.source, kept.term, coalesce(counted.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(counted.c, 0) + 2)) // (coalesce(sums.n, 0) + 2 * langs.v) AS p,
        1 + (1000000000::HUGEINT * (kept.total + 2)) // (langs.n + 2 * langs.v) AS q
    FROM cells JOIN kept USING (lang) JOIN langs USING (lang)
    LEFT JOIN counted ON counted.lang = cells.lang AND counted.source = cells.source AND counted.term = kept.term
    LEFT JOIN sums ON sums.lang = cells.lang AND sums.source = cells.source
), far AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

FILTER_AUDIT = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), known AS (
    SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT texts.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 200)::INTEGER
        + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
        + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
        + 16 * coalesce(min(texts.doc_id) OVER (PARTITION BY text) < texts.doc_id, false)::INTEGER AS mask
    FROM texts LEFT JOIN known USING (doc_id)
), masks AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
        [a.name, b.name, c.name, d.name, e.name] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
    JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), steps AS (
    SELECT filter_order, step, names[step] AS filter, bits[step] AS bit,
        coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, filter_order, step, filter,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""

SUFFIX_ARRAY_DEDUP = r"""
WITH texts AS (
    SELECT row_number() OVER () AS place, doc_id, coalesce(doc_id, 9223372036854775807) AS id_order,
        hex(encode(coalesce(text, ''))) AS digits
    FROM documents
), bytes AS (
    SELECT place, id_order, p, substr(digits, 2 * p + 1, 2) AS byte, substr(digits, 2 * p + 1, 100) AS string
    FROM (SELECT *, unnest(range(length(digits) // 2)) AS p FROM texts)
), firsts AS (
    SELECT string, min(id_order) AS low FROM bytes WHERE length(string) = 100 GROUP BY string
), marked AS (
    SELECT place, p, byte, coalesce(low < id_order, false)::INTEGER AS begins FROM bytes LEFT JOIN firsts USING (string)
), gone AS (
    SELECT place, p, byte,
        max(begins) OVER (PARTITION BY place ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed
    FROM marked
), spans AS (
    SELECT *, removed - coalesce(lag(removed) OVER (PARTITION BY place ORDER BY p), 0) = 1 AS opens FROM gone
), cut AS (
    SELECT place, count(*) AS n_bytes, sum(removed) AS n_removed, count(*) FILTER (opens) AS n_spans,
        string_agg(CASE WHEN removed = 0 THEN byte ELSE '' END, '' ORDER BY p) AS kept
    FROM spans GROUP BY place
)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN cut USING (place)
"""
