"""The quality rules in the checking engine's SQL: windows and lines are unnested and counted."""

ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
grams AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
again AS (SELECT r, sum(least(8, coalesce(i - before, 8))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r),
parts AS (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
lines AS (
  SELECT r, pos, l, length(translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS wc,
    row_number() OVER (PARTITION BY r, l ORDER BY pos) > 1 AS dup,
    list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw,
    length(l) - length(translate(l, '#*$%&|<>', '')) AS syms,
    length(l) - length(translate(l, '|»›·', '')) AS bars
  FROM parts),
lost AS (
  SELECT r, count(*) FILTER (WHERE wc > 0 AND dup) AS dups, sum(wc) FILTER (WHERE wc > 0 AND (
      dup OR 10 * syms > wc
      OR (wc >= 20 AND translate(l, 'abcdefghijklmnopqrstuvwxyz', '') = l AND translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '') <> l)
      OR (bars >= 2 AND len(lw) < 6 * (bars + 1))
      OR (wc < 25 AND len(lw) < 5 AND NOT regexp_matches(l, '[.!?…:;"”»)。！？][\x20\x09-\x0D]*$'))
      OR (wc < 200 AND regexp_matches(lower(l), '(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|click here|read more|sign (in|up)|log in|subscribe (now|to our)|enable javascript|share this|back to top|skip to content)'))
      OR (len(lw) >= 12 AND 3 * len(list_distinct(lw)) < len(lw)))) AS chars
  FROM lines GROUP BY r),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN again USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM f
"""
