"""The operators that SQL can express, as DuckDB SQL over the same tables."""

MIXING = r"""
WITH sized AS (
    SELECT *, greatest(length(coalesce(text, '')), 1) AS _n FROM documents
), sizes AS (
    SELECT source AS s, sum(_n)::DOUBLE AS size FROM sized GROUP BY source
), means AS (
    SELECT s, 1.0 * (SELECT sum(size) FROM sizes) * pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) / size AS mean FROM sizes
), hashed AS (
    SELECT d.*, mean, (('0x' || substr(md5('42:' || doc_id || ':' || md5(coalesce(text, '')) || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
    FROM sized d JOIN means m ON d.source IS NOT DISTINCT FROM m.s
), counted AS (
    SELECT *, len(list_filter(range(0, 200), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(mean) - mean - lgamma(j + 1)))) < u)) AS n FROM hashed
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('42:order:' || doc_id || ':' || md5(coalesce(text, '')) || ':' || copy) AS order_key
FROM counted, unnest(range(0, n)) AS t(copy)
"""

LINE_DEDUP = r"""
WITH raw AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, k, trim(parts[k + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
    FROM raw, unnest(range(0, len(parts))) AS t(k)
), worded AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE line <> ''
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM worded
), ends AS (
    SELECT a.doc_id, a.p AS first, min(b.p) AS last FROM placed a JOIN placed b
    ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.p) AS first, b.p AS last FROM placed a JOIN placed b
    ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
), windows AS (
    SELECT e.doc_id, e.first, e.last, min(p.k) AS ka, max(p.k) AS kb, string_agg(p.line, chr(10) ORDER BY p.p) AS content
    FROM ends e JOIN placed p ON p.doc_id = e.doc_id AND p.p BETWEEN e.first AND e.last GROUP BY ALL
), ranked AS (
    SELECT *, min((doc_id, ka)) OVER (PARTITION BY content) AS origin FROM windows
), gone AS (
    SELECT DISTINCT doc_id, k FROM ranked, unnest(range(ka, kb + 1)) AS t(k) WHERE (doc_id, ka) > origin
), left_over AS (
    SELECT r.doc_id, string_agg(r.parts[t.k + 1], chr(10) ORDER BY t.k) AS text, count(*) AS n
    FROM raw r, unnest(range(0, len(r.parts))) AS t(k) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.k = t.k) GROUP BY r.doc_id
)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
    coalesce(len(r.parts), 0)::BIGINT AS lines_before, coalesce(l.n, 0)::BIGINT AS lines_after
FROM raw r LEFT JOIN left_over l ON r.doc_id = l.doc_id
"""

QUALITY = r"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS w FROM base, unnest(range(1, len(words) - 3)) AS t(i)
), again AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) AS t(j) GROUP BY doc_id
), trimmed AS (
    SELECT doc_id, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM base, unnest(lines) AS u(x)
), judged AS (
    SELECT *, regexp_matches(t, {end}) AND NOT regexp_matches(t, {navigation}) AND NOT regexp_matches(t, {breadcrumb}) AND NOT regexp_matches(t, {boilerplate}) AS good FROM trimmed
), per AS (
    SELECT doc_id, count(*) FILTER (WHERE NOT good) AS removed, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE good), 0) AS kept_chars FROM judged GROUP BY doc_id
), measured AS (
    SELECT b.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, coalesce(p.removed, 0)::BIGINT AS n_lines_removed, coalesce(p.kept_chars, 0)::BIGINT AS kept_chars
    FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id LEFT JOIN per p ON b.doc_id = p.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_lines, n_lines_removed, kept_chars,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (word_chars - kept_chars) <= 50 * word_chars AS kept
FROM measured
"""


def oracle_sql() -> dict[str, str]:
    from . import quality

    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in (("end", quality.SENTENCE_END), ("navigation", quality.NAVIGATION), ("breadcrumb", quality.BREADCRUMB), ("boilerplate", quality.BOILERPLATE))}
    return {"op2_mixing": MIXING, "op5_line_dedup": LINE_DEDUP, "op8_quality": QUALITY.format(**quoted)}
