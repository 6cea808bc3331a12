"""The same results in plain SQL, where SQL can state them."""

_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), counted AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, len(ls) AS n_lines,
         length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (rid)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * n_symbols // greatest(n_words, 1) AS symbols,
         1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeat_words,
         1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM counted
), long AS (
  SELECT lang, source, 'symbols' AS measure, symbols AS v, 250 AS floor FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', dup_lines, 150 FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeat_words', repeat_words, 100 FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', word_length, 500 FROM m WHERE NOT base_failed
), bucketed AS (
  SELECT lang, source, measure, floor, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS b
  FROM long
), quarters AS (
  SELECT lang, source, measure, any_value(floor) AS floor, count(*) AS n,
         min(CASE WHEN 4 * cum >= al THEN b END) AS q1, min(CASE WHEN 4 * cum >= 3 * al THEN b END) AS q3
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, source, measure ORDER BY b) AS cum,
               count(*) OVER (PARTITION BY lang, source, measure) AS al FROM bucketed)
  GROUP BY ALL
), wide AS (
  SELECT lang, measure, any_value(floor) AS floor,
         min(CASE WHEN 4 * cum >= al THEN b END) AS q1, min(CASE WHEN 4 * cum >= 3 * al THEN b END) AS q3
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, measure ORDER BY b) AS cum,
               count(*) OVER (PARTITION BY lang, measure) AS al FROM bucketed)
  GROUP BY ALL
), chosen AS (
  SELECT q.lang, q.source, q.measure, q.floor, CASE WHEN q.n < 30 THEN w.q1 ELSE q.q1 END AS q1,
         CASE WHEN q.n < 30 THEN w.q3 ELSE q.q3 END AS q3
  FROM quarters q JOIN wide w ON q.lang IS NOT DISTINCT FROM w.lang AND q.measure = w.measure
), l AS (
  SELECT lang, source,
         max(CASE WHEN measure = 'symbols' THEN q3 + 3 * greatest(q3 - q1, floor) END) AS a,
         max(CASE WHEN measure = 'dup_lines' THEN q3 + 3 * greatest(q3 - q1, floor) END) AS b,
         max(CASE WHEN measure = 'repeat_words' THEN q3 + 3 * greatest(q3 - q1, floor) END) AS c,
         max(CASE WHEN measure = 'word_length' THEN q3 + 3 * greatest(q3 - q1, floor) END) AS d,
         max(CASE WHEN measure = 'word_length' THEN q1 - 3 * greatest(q3 - q1, floor) END) AS e
  FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= a AND dup_lines <= b AND repeat_words <= c
                                    AND word_length <= d AND word_length >= e, FALSE) AS kept
FROM m LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""

_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS perm
  FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE position % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources
), filled AS (
  SELECT *, row_number() OVER f AS turn, sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         3 * sum(s) OVER () - 4 * coalesce(sum(s) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2
  FROM weighted WINDOW f AS (ORDER BY 2 * s / w, position)
), level AS (
  SELECT turn, left2, open_w FROM filled WHERE 4 * s * open_w >= left2 * w ORDER BY turn LIMIT 1
), target AS (
  SELECT f.source, f.s, CASE WHEN l.turn IS NULL OR f.turn < l.turn THEN (2 * f.s)::DOUBLE
                             ELSE (l.left2 * f.w)::DOUBLE / (2 * l.open_w)::DOUBLE END AS target
  FROM filled f LEFT JOIN level l ON TRUE
), ranked AS (
  SELECT d.doc_id, d.size, t.s AS source_size, t.target,
         CASE WHEN t.s > 0 THEN floor(t.target / t.s) ELSE 0 END AS rounds,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.perm, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (rounds + CASE WHEN target - rounds * source_size > 0
                               AND 2 * before + size <= 2 * (target - rounds * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _QUALITY, "op5_mixing": _MIXING}
