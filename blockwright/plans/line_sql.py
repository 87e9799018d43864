"""The line and block rules once more, in DuckDB's SQL: words as rows and counts by grouping, where Spark uses arrays.

Each function gives common table expressions to build a query on.
"""

from __future__ import annotations

from ..functions import lexicon
from ..functions.words import DATE, RANGE, VALUE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


_CASED = r"\p{Lu}\p{Lt}\p{Ll}"
TITLE = quoted(rf"^[^{_CASED}]*[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*([^{_CASED}]+[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*)*[^{_CASED}]*$")
UPPER = quoted(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$")
CLOSERS = r"""["“‘’”'\s]*$"""
#: RE2 has no look-around: year 0000 and the need for a digit are tested apart.
_DATE = quoted(DATE.replace("(?!0000)", ""))
_VALUE = quoted(VALUE.replace(r"(?=.*\p{N})", ""))


def lines(table: str = "documents", keys: str = "doc_id", text: str = "text", xml: bool = False) -> str:
    """lines (keys, n, line): all, cleaned; kept: those that stay."""
    return rf"""
split_lines AS (SELECT {keys}, string_split(coalesce({text}, ''), chr(10)) AS ls FROM {table}),
lines AS (SELECT {keys}, n, regexp_replace(replace(raw, chr(9), ' '), '^\s+|\s+$', '', 'g') AS line FROM (SELECT {keys}, unnest(range(len(ls))) AS n, unnest(ls) AS raw FROM split_lines)),
kept AS (SELECT {keys}, n, line FROM lines WHERE length(line) > {0 if xml else 2}
         QUALIFY row_number() OVER (PARTITION BY {keys}, regexp_replace(line, '\p{{Nd}}+', '', 'g') ORDER BY n) = 1)"""


def features(keys: str = "doc_id", source: str = "kept") -> str:
    """features: keys, n, line and the columns of the line rules."""
    return rf"""
split_words AS (SELECT {keys}, n, line, regexp_split_to_array(line, '\s+') AS ts FROM {source}),
raw_words AS (SELECT {keys}, n, line, ts, unnest(ts) AS raw, unnest(range(len(ts))) AS i FROM split_words),
trimmed AS (SELECT *, CASE WHEN regexp_matches(raw, '[[:punct:]”]$') AND NOT regexp_matches(raw, '^[[:punct:]“]') AND (i > 0 OR raw LIKE '%:') THEN left(raw, length(raw) - 1) ELSE raw END AS t FROM raw_words),
kinds AS (SELECT *, regexp_matches(t, '^\p{{L}}+$') AS alpha, regexp_matches(lower(t), '^\p{{N}}+$') AS numeral, lower(t) AS low FROM trimmed WHERE t <> ''),
bare AS (SELECT *, CASE WHEN alpha OR numeral THEN low ELSE regexp_replace(regexp_replace(low, '^\((.*)\)$', '\1'), '^-', '') END AS p FROM kinds),
signs AS (SELECT *, NOT (alpha OR numeral) AND regexp_matches(p, '^\$|\$$') AS dollar FROM bare),
signs2 AS (SELECT *, NOT (alpha OR numeral) AND NOT dollar AND p LIKE '%\%' ESCAPE '\' AS pct FROM signs),
plain AS (SELECT *, CASE WHEN alpha OR numeral THEN p ELSE replace(regexp_replace(CASE WHEN dollar AND p LIKE '$%' THEN p[2:] WHEN dollar OR pct THEN left(p, length(p) - 1) ELSE p END, '^\((.*)\)$', '\1'), ',', '') END AS v FROM signs2),
flags AS (SELECT *, numeral OR (NOT alpha AND regexp_matches(v, {_VALUE}) AND regexp_matches(v, '\p{{N}}')) AS value FROM plain),
words AS (SELECT *, value AND coalesce(round_even(try_cast(v AS DOUBLE), 0) BETWEEN 1000 AND 9999, false) AND NOT contains(t, ',') AS yr,
  NOT alpha AND regexp_matches(t, '[/-]') AND regexp_matches(replace(t, '/', '-'), {_DATE}) AND NOT regexp_matches(replace(t, '/', '-'), '-0000$') AS dated,
  NOT alpha AND regexp_matches(v, {quoted(RANGE)}) AS ranged, low IN {listed(lexicon.STOP_WORDS)} AS stop, regexp_matches(t, {TITLE}) OR regexp_matches(t, {UPPER}) AS title FROM flags),
counts AS (
  SELECT {keys}, n, line, any_value(ts) AS ts, len(any_value(ts)) AS word_count, count(*) FILTER (title) AS title_word_count, count(*) FILTER (alpha) AS alpha_count,
    count(*) FILTER (value AND NOT yr) AS number_count, count(*) FILTER (dollar) AS dollar_count, count(*) FILTER (pct) AS pct_count, count(*) FILTER (dated) AS date_entry_count,
    count(*) FILTER (stop AND i < coalesce(nullif(list_position(list_transform(ts, lambda x: contains(x, ':')), true), 0) - 1, 1000000)) AS stop_word_count,
    count(*) FILTER (length(t) = 1) AS single_count, count(*) AS used_words, coalesce(len(list_filter(any_value(ts), lambda x: x = '$')), 0) AS dollar_sign_count,
    bool_or(i = len(ts) - 1 AND ((value AND NOT yr) OR dollar OR pct)) AS last_word_number, bool_or(i = len(ts) - 1 AND dated) AS last_word_date,
    bool_or(i = len(ts) - 1 AND stop AND length(t) <> 1 AND NOT regexp_matches(t, {UPPER})) AS last_word_is_stop_word,
    bool_or(i > 0 AND low IN {listed([*lexicon.STATES, *lexicon.STATE_CODES])} AND ts[i] LIKE '%,') AS contains_state, bool_or(low LIKE 'page%') AS contains_page,
    list(t ORDER BY i)[1] AS w1, coalesce(list(t ORDER BY i)[2], '') AS w2
  FROM words GROUP BY {keys}, n, line),
numbers AS (SELECT *, CASE WHEN contains(cut, ')(') THEN string_split(cut, ')(')[1] ELSE cut END AS num FROM (
  SELECT *, CASE WHEN opened THEN cut0[2:] ELSE cut0 END AS cut FROM (
    SELECT *, CASE WHEN closed THEN left(w1, length(w1) - 1) ELSE w1 END AS cut0 FROM (SELECT *, w1 LIKE '%.' OR w1 LIKE '%)' AS closed, w1 LIKE '(%' AS opened FROM counts)))),
parts AS (SELECT *, string_split(num, '.') AS ps FROM numbers),
numbered AS (SELECT *, CASE WHEN lower(w1) IN ('i', 'a') OR (opened AND w1 NOT LIKE '%)') OR regexp_matches(w1, '[%$,]$') THEN false ELSE
  (list_reduce(list_transform(ps, lambda x, k: {{'part': x, 'at': k - 1, 'g': false, 'r': false, 'l': false, 'd': false, 'm': false, 'on': false}}),
    lambda s, x: CASE WHEN NOT s.on THEN s ELSE {{'part': x.part, 'at': x.at,
      'g': CASE WHEN length(x.part) <= 2 THEN regexp_matches(x.part, '^\p{{Nd}}+$') AND (len(ps) > 1 OR w1 LIKE '%)') ELSE s.g END,
      'r': CASE WHEN length(x.part) <= 6 THEN regexp_matches(x.part, '^[ixvIXV]+$') AND x.at = 0 ELSE s.r END,
      'l': CASE WHEN length(x.part) <= 2 THEN regexp_matches(x.part, '^[a-zA-Z]') AND ((closed AND length(x.part) = 1 AND len(ps) = 1) OR regexp_matches(regexp_replace(x.part, '[a-zA-Z]+', '', 'g'), '^\p{{Nd}}+$') OR x.at > 0) ELSE s.l END,
      'd': CASE WHEN length(x.part) <= 2 THEN regexp_matches(x.part, '^\p{{Nd}}+$') AND (len(ps) > 1 OR w1 LIKE '%.') ELSE s.d END,
      'm': s.m OR (regexp_matches(x.part, '^[\p{{L}}\p{{N}}]') AND x.part LIKE '%)' AND contains(x.part, '(')),
      'on': ((CASE WHEN length(x.part) <= 2 THEN regexp_matches(x.part, '^\p{{Nd}}+$') AND (len(ps) > 1 OR closed) ELSE s.g OR s.d END)
        OR (CASE WHEN length(x.part) <= 6 THEN regexp_matches(x.part, '^[ixvIXV]+$') AND x.at = 0 ELSE s.r END)
        OR (CASE WHEN length(x.part) <= 2 THEN regexp_matches(x.part, '^[a-zA-Z]') AND ((closed AND length(x.part) = 1 AND len(ps) = 1) OR regexp_matches(regexp_replace(x.part, '[a-zA-Z]+', '', 'g'), '^\p{{Nd}}+$') OR x.at > 0) ELSE s.l END))
        AND NOT (s.m OR (regexp_matches(x.part, '^[\p{{L}}\p{{N}}]') AND x.part LIKE '%)' AND contains(x.part, '(')))}} END,
    {{'part': '', 'at': 0::BIGINT, 'g': false, 'r': false, 'l': false, 'd': false, 'm': false, 'on': true}})).on END AS numbered_line FROM parts),
ends AS (SELECT *, ts[1] AS first_word, ts[-1] AS last_word, right(line, 1) AS last_char, left(line, 1) AS first_char, alpha_count - stop_word_count AS eff_word_count,
  regexp_matches(line, '[.;:]{{2,}}{CLOSERS.replace("'", "''")}') OR (regexp_matches(line, '[.;:]{CLOSERS.replace("'", "''")}') AND NOT regexp_matches(line, '([.;:][a-zA-Z0-9]|INC|inc|Inc)[.;:]{CLOSERS.replace("'", "''")}')) AS sentence_end,
  right(line, 1) = '.' AND ts[-1] NOT IN ('Mr.', 'Dr.', 'Mrs.') AS ends_with_period FROM numbered),
firsts AS (SELECT *, NOT numbered_line AND (regexp_matches(first_char, '\p{{Ll}}') OR contains({quoted(lexicon.CONTINUING)}, first_char)) AS has_continuing_chars,
  (word_count = 3 AND last_word_number AND lower(first_word) IN ('po', 'p.o', 'p.o.')) OR (word_count < 7 AND contains_state AND (last_word_number OR regexp_matches(right(last_word, 4), '^\p{{Nd}}+$'))
    AND ((length(last_word) = 10 AND last_word[6] = '-') OR length(last_word) = 5) AND NOT ends_with_period) AS is_zipcode_or_po,
  first_char IN {listed(lexicon.BULLETS)} AS has_list_char, CASE WHEN eff_word_count > 0 THEN title_word_count / eff_word_count ELSE 1.0 END AS title_ratio FROM ends),
shaped AS (SELECT *, has_list_char AND right(first_word, 1) NOT IN (':', '?', '.', ')', ']', '%', '$') AS is_list_item,
  ((lower(first_word) IN ('section', 'article', 'note') OR (title_ratio > 0.9 AND eff_word_count < 10)) AND number_count = 1) OR numbered_line OR regexp_matches(line, {UPPER}) AS structured FROM firsts),
headed AS (SELECT *, line LIKE '\%%' ESCAPE '\' OR regexp_matches(line, '^\d+\.\s+(\d+|[A-Z])') OR (numbered_line AND used_words > 1 AND (regexp_matches(w2, '^\p{{Nd}}+$') OR regexp_matches(w2, '^\p{{Lu}}'))) AS sure,
  NOT (ends_with_period AND NOT (structured AND title_ratio > 0.9) AND sentence_end) AND NOT has_list_char AND first_char <> '©' AND title_ratio > 0.9 AND eff_word_count < 10
  AND NOT (lower(last_word) IN {listed(lexicon.UNITS)} OR (last_word_number AND NOT structured)) AND (number_count = 0 OR (structured AND number_count <= 1)) AND NOT has_continuing_chars
  AND NOT (last_word_date AND NOT structured) AND regexp_matches(w1, '^\p{{Lu}}') AND NOT last_word_is_stop_word AND NOT is_zipcode_or_po
  AND NOT (regexp_matches(last_word, '[[:punct:]“]$') AND right(last_word, 1) NOT IN (':', '?', '.', ')', ']', '%') AND sentence_end) AND NOT contains(line, '://') AND NOT (contains_page AND number_count = 1)
  AND NOT (regexp_matches(last_word, '^\p{{Nd}}+$') AND used_words < 5) AS plain_header FROM shaped),
rows_ AS (SELECT *, sure OR (plain_header AND (length(line) - length(replace(line, ',', '')) <= 1 OR lower(line) LIKE 'section%')) AS is_header,
  number_count + dollar_count + pct_count + (length(line) - length(replace(line, ' - ', ''))) // 3 AS value_count FROM headed),
features AS (SELECT *, NOT is_header AND (((value_count > 0 OR date_entry_count > 0) AND (value_count + title_word_count + date_entry_count) / greatest(word_count - dollar_sign_count, CASE WHEN word_count = dollar_sign_count THEN 1 ELSE 0 END) > 0.7
    AND NOT ends_with_period AND NOT is_zipcode_or_po AND NOT last_word_is_stop_word) OR contains(line, '....')) AS is_table_row FROM rows_),
typed AS (SELECT *, CASE WHEN is_table_row THEN 'table_row' WHEN is_header THEN 'header' WHEN is_list_item OR numbered_line THEN 'list_item' ELSE 'para' END AS line_type,
  is_table_row OR is_list_item AS is_list_or_row, has_continuing_chars AND NOT (is_header OR is_table_row OR is_list_item OR is_zipcode_or_po) AS continuing_line,
  NOT (is_header OR is_table_row OR is_zipcode_or_po) AND (NOT ends_with_period OR instr(last_word, '.') <> length(last_word) OR lower(last_word) IN {listed(lexicon.ABBREVIATIONS)} OR length(last_word) <= 3
    OR (length(line) > 2 AND line[-2:-2] = '.')) AS incomplete_line FROM features)"""


def blocks(keys: str = "doc_id") -> str:
    """blocks: keys, block_idx, block_text, block_type, header_block_idx; on features()."""
    return rf"""
ab AS (SELECT *, lag(n) OVER w IS NOT NULL AND (continuing_line OR (coalesce(lag(incomplete_line) OVER w, false) AND NOT (is_list_or_row OR line_type = 'list_item'))) AS a,
  lag(n) OVER w IS NOT NULL AND NOT coalesce(lag(ends_with_period) OVER w, false) AND NOT (is_list_or_row OR line_type = 'list_item') AS b FROM typed WINDOW w AS (PARTITION BY {keys} ORDER BY n)),
joined AS (SELECT *, coalesce(max(n) FILTER (a) OVER w >= max(n) FILTER (NOT b) OVER w, false) AS j FROM ab WINDOW w AS (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING)),
numbered_blocks AS (SELECT *, (sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS block_idx FROM joined),
texts AS (SELECT {keys}, block_idx, string_agg(CASE WHEN n = m THEN line WHEN line LIKE '%-' THEN left(line, length(line) - 1) ELSE line || ' ' END, '' ORDER BY n) AS block_text, arg_min(line_type, n) AS first_type, count(*) AS lines
  FROM (SELECT *, max(n) OVER (PARTITION BY {keys}, block_idx) AS m FROM numbered_blocks) GROUP BY {keys}, block_idx),
ends_of AS (SELECT *, CASE WHEN lines > 1 AND first_type <> 'list_item' THEN 'para' ELSE first_type END AS block_type, lead(block_idx) OVER (PARTITION BY {keys} ORDER BY block_idx) IS NULL AS is_last FROM texts),
blocks AS (SELECT {keys}, block_idx, block_type, CASE WHEN is_last AND block_type = 'list_item' AND contains({quoted("�\\*,.?•➢ƒ–'\"—")}, left(block_text, 1)) THEN regexp_replace(block_text[2:], '^\s+', '') ELSE block_text END AS block_text,
  coalesce(max(block_idx) FILTER (block_type = 'header' AND NOT is_last) OVER (PARTITION BY {keys} ORDER BY block_idx ROWS UNBOUNDED PRECEDING), -1) AS header_block_idx FROM ends_of)"""
