"""SQL with the same result, for the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _fits(text: str, cut: str) -> str:
    """Whether every stretch between cuts, without white space around it, has at most 500 characters."""
    bare = f"regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')"
    return f"len(list_filter(regexp_split_to_array({text}, '{cut}'), lambda x: length({bare}) > 500)) = 0"


SQL = {
    "p7_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\pL\pN]+') AS ws FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(ws[j:j + 11], ' ') AS r FROM i, unnest(range(1, len(ws) - 10)) AS u(j)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM documents),
h AS (SELECT doc_id, array_to_string(ws[j:j + 11], ' ') AS r FROM d, unnest(range(1, len(ws) - 10)) AS u(j))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (r)""",
    "p1_found": "SELECT parent_key, CASE WHEN "
    + _fits("page_content", r"\n(?:[\t\r\f\v \x{a0}\x{2000}-\x{200a}]*\n)+")
    + " THEN 'paragraph' WHEN "
    + _fits("page_content", r"\n")
    + " THEN 'line' WHEN "
    + _fits(r"regexp_replace(page_content, '([.!?])" + _WS + r"+', '\1' || chr(10), 'g')", r"\n")
    + " THEN 'sentence' WHEN "
    + _fits("page_content", _WS + "+")
    + " THEN 'word' ELSE 'none' END AS cut_level FROM parent_docs WHERE length(page_content) > 500",
    "p3_found": r"""WITH l AS (SELECT source, parent_key, i::INT AS line_no, regexp_replace(lower(string_split(page_content, chr(10))[i]), '[\s\pZ\p{Cf}\p{Cc}\p{Nd}]+', '', 'g') AS sq
  FROM parent_docs, unnest(range(1, len(string_split(page_content, chr(10))) + 1)) AS u(i) WHERE source IS NOT NULL AND page_content IS NOT NULL),
n AS (SELECT source, count(*) AS n FROM parent_docs WHERE source IS NOT NULL AND page_content IS NOT NULL GROUP BY ALL),
f AS (SELECT source, sq FROM l JOIN n USING (source) WHERE regexp_matches(sq, '\pL') GROUP BY source, sq, n HAVING count(DISTINCT parent_key) >= greatest(5, 0.02 * n))
SELECT parent_key, line_no FROM l JOIN f USING (source, sq)""",
    "p5_statistics": r"""WITH w AS (SELECT *, regexp_extract_all(lower(content), '[\pL\pN][\pL\pM\pN''’-]*') AS ws,
  list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^\s\pZ]')) AS ls, length(regexp_replace(content, '[\s\pZ]+', '', 'g')) AS nc FROM sections),
c AS (SELECT list(lower(word)) AS common FROM common_words)
SELECT ordinal, CASE WHEN content IS NULL THEN NULL ELSE len(ws)::INT END AS n_words, CASE WHEN content IS NULL THEN NULL WHEN len(ws) > 0 THEN round(list_sum(list_transform(ws, lambda x: length(x))) / len(ws), 6)::DOUBLE ELSE 0.0::DOUBLE END AS mean_word_len,
  CASE WHEN content IS NULL THEN NULL WHEN nc > 0 THEN round(length(regexp_replace(content, '[\s\pZ\pL\pM\pN]+', '', 'g')) / nc, 6) ELSE 0.0::DOUBLE END AS symbol_ratio,
  CASE WHEN content IS NULL THEN NULL WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?;:,][\s\pZ]*$'))) / len(ls), 6) ELSE 0.0::DOUBLE END AS punct_line_share,
  CASE WHEN content IS NULL THEN NULL WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: list_contains(common, x))) / len(ws), 6) ELSE 0.0::DOUBLE END AS common_share
FROM w, c WHERE content IS NOT NULL""",
}
