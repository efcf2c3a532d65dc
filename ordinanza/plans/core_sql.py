"""DuckDB SQL with the same result as each query of ``core``, written from the same lexicon tables."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import SPACE

_SP = SPACE.replace("'", "''")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(p)})" for p in phrases) + ")"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', '')"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_SP}+'), lambda t: t <> '')"


_REF = r"\b(\d+\.\d+\.\d+(?:\.\d+)*)\b"

ELEMENTS = """
el_last AS (SELECT source, page, max(scanned_at) AS s FROM ocr_elements GROUP BY ALL),
el_now AS (SELECT e.*, row_number() OVER (PARTITION BY e.source, e.page, e.elem_no ORDER BY e.loaded_at DESC, e.text DESC NULLS LAST) AS n
  FROM ocr_elements e JOIN el_last l ON e.source IS NOT DISTINCT FROM l.source AND e.page IS NOT DISTINCT FROM l.page AND e.scanned_at IS NOT DISTINCT FROM l.s),
el AS (SELECT source, page, elem_no, text FROM el_now WHERE n = 1)"""
ELEMENTS_TEXT = ELEMENTS.replace("FROM ocr_elements", "FROM (SELECT * FROM ocr_elements WHERE source IS NOT NULL AND text IS NOT NULL)")

LINES = f"""WITH {ELEMENTS_TEXT},
ln AS (SELECT source, page, elem_no, {_strip('text')} AS line FROM el),
nu AS (SELECT *, regexp_extract(line, '^(\\d+\\.\\d+\\.\\d+)', 1) AS num FROM ln WHERE line <> ''),
gr AS (SELECT *, sum((num <> '')::INT) OVER (PARTITION BY source ORDER BY page, elem_no ROWS UNBOUNDED PRECEDING) AS header_no FROM nu),
secs AS (SELECT source, header_no::BIGINT AS header_no, max(num) AS section, string_agg(line, chr(10) ORDER BY page, elem_no) AS content FROM gr WHERE header_no > 0 GROUP BY ALL)
"""

INLINE = r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '(\d{1,2}\.\d{1,2}\.\d{1,3})', 1) AS nums, regexp_split_to_array(text, '\d{1,2}\.\d{1,2}\.\d{1,3}')[2:] AS bodies FROM documents),
secs AS (SELECT doc_id, (i - 1)::INT AS ordinal, nums[i] AS section, bodies[i] AS content FROM a, unnest(range(1, len(nums) + 1)) AS u(i))
"""


def _section_bonus(c: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(coalesce({c}, ''), {_q(p)}) THEN {n}" for p, n in L.SECTION_BONUS) + " ELSE 0 END"


def _quality_bonus(c: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {_any(f'lower(coalesce({c}, chr(32)))', ps)} THEN {n} ELSE 0 END" for n, ps in L.QUALITY_BONUS) + ")"


def _word_match(q: str, c: str) -> str:
    both = (_tokens(f"lower(coalesce({x}, ''))") for x in (q, c))
    return "len(list_distinct(list_intersect({}, {})))".format(*both)


def _relevance(q: str, s: str, c: str) -> str:
    return f"({_word_match(q, c)} + {_section_bonus(s)} + {_quality_bonus(c)})::INT"


ANSWERED = """WITH an AS (SELECT a.question_id, q.question, (i - 1)::INT AS ord, a.documents[i].section AS section, a.documents[i].content AS content
  FROM answers a JOIN questions q ON a.question_id = q.question_id, unnest(range(1, len(a.documents) + 1)) AS u(i))"""


def _expand(k: int) -> str:
    parts = " || ".join(["[question]"] + [f"CASE WHEN {_any('lower(question)', t)} THEN {_list(v)} ELSE []::VARCHAR[] END" for t, v in L.QUESTION_TOPICS])
    return f"""ex0 AS (SELECT question_id, question, ({parts})[1:6] AS qs FROM questions WHERE question IS NOT NULL),
ex AS (SELECT question_id, question, (i - 1)::INT AS query_ord, qs[i] AS query, greatest(2, {k} // len(qs))::INT AS k FROM ex0, unnest(range(1, len(qs) + 1)) AS u(i))"""


INDEX = "idx AS (SELECT d.doc_id, d.section, d.text AS content, d.source, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


def _hits(name: str, queries: str, ords: str, slot: str) -> str:
    """CTE of the k best index rows of every query row of ``queries``."""
    return f"""{name}_v AS (SELECT q.*, e.embedding AS qv FROM {queries} q JOIN embeddings e ON e.vec_id = ({slot}) % 500),
{name}_d AS (SELECT v.question_id, {ords}, v.k, i.doc_id, i.section, i.content,
  round(list_sum(list_transform(list_zip(v.qv, i.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS dist FROM {name}_v v, idx i),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, {ords} ORDER BY dist, doc_id) AS rank FROM {name}_d) WHERE rank <= k)"""


def _first(name: str, hits: str, ords: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {ords}, rank) AS first_seen FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id, left(content, 100) ORDER BY {ords}, rank) AS n1 FROM {hits}) WHERE n1 = 1)"""


def _smart(k: int) -> str:
    return f"""{INDEX}, {_expand(k)},
{_hits('h', 'ex', 'query_ord', 'q.question_id * 6 + q.query_ord')},
{_first('f', 'h', 'query_ord')},
sc AS (SELECT f.*, x.question, {_relevance('x.question', 'f.section', 'f.content')} AS score FROM f JOIN ex0 x ON f.question_id = x.question_id),
sm AS (SELECT question_id, rank2::INT AS rank, doc_id, section, content, score FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_seen) AS rank2 FROM sc) WHERE rank2 <= {k})"""


def _context(name: str, docs: str) -> str:
    return f"""{name} AS (SELECT question_id, string_agg('Section ' || s || ':' || chr(10) || CASE WHEN length(c) > 1000 THEN left(c, 1000) || '...' ELSE c END, chr(10) || chr(10) ORDER BY rank) AS context
  FROM (SELECT question_id, rank, coalesce(section, 'Unknown') AS s, coalesce(content, '') AS c, row_number() OVER (PARTITION BY question_id, coalesce(section, 'Unknown') ORDER BY rank) AS n FROM {docs} WHERE rank <= 8) WHERE n = 1 GROUP BY ALL)"""


def _self_query(questions: str) -> str:
    return f"""sq0 AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(coalesce(question, ''), '{_REF}', 1)) AS section FROM {questions}),
sq AS (SELECT * FROM (SELECT s.question_id, d.doc_id, s.section, row_number() OVER (PARTITION BY s.question_id ORDER BY d.doc_id) AS rank FROM sq0 s JOIN documents d ON d.section = s.section) WHERE rank <= 8)"""


ANSWER_Q = "aq AS (SELECT a.question_id, a.answer AS question FROM answers a JOIN questions q ON a.question_id = q.question_id WHERE a.answer IS NOT NULL)"


def _merge(once: bool, few: str, cap: str) -> str:
    n = "row_number() OVER (PARTITION BY f.question_id, f.section ORDER BY f.rank)" if once else "1"
    return f"""{ANSWERED}, {ANSWER_Q}, {_self_query('aq')},
fd AS (SELECT question_id, ord + 1 AS rank, section, content FROM an),
nd AS (SELECT question_id, count(*) AS c FROM fd GROUP BY ALL),
nw AS (SELECT * FROM (SELECT f.question_id, f.rank, f.section, d.text AS content, {n} AS n FROM sq f JOIN documents d ON f.doc_id = d.doc_id LEFT JOIN nd ON nd.question_id = f.question_id
  WHERE {few} NOT EXISTS (SELECT 1 FROM fd WHERE fd.question_id = f.question_id AND fd.section IS NOT DISTINCT FROM f.section)) WHERE n = 1),
al AS (SELECT question_id, section, content, row_number() OVER (PARTITION BY question_id ORDER BY part, rank, section, content)::INT AS rank
  FROM (SELECT *, 0 AS part FROM fd UNION ALL BY NAME SELECT question_id, rank, section, content, 1 AS part FROM nw))
SELECT question_id, rank, section, md5(content) AS content_md5 FROM al {cap}"""


def _refs_all(c: str) -> str:
    pats = [r"(?i)section\s+(\d+\.\d+\.\d+(?:\.\d+)*)", r"(?i)\b(\d+\.\d+\.\d+(?:\.\d+)*)\b", r"(?i)chapter\s+(\d+\.\d+)"]
    return "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all(coalesce({c}, ''), '{p}', 1)" for p in pats) + "))"


def _case(col: str, groups, wrap) -> str:
    return "CASE " + " ".join(f"WHEN {_any(col, t)} THEN {wrap(v)}" for t, v in groups) + " ELSE []::VARCHAR[] END"


def _topic_searches(q: str, a: str) -> str:
    a, q = f"lower(coalesce({a}, ''))", f"lower(coalesce({q}, ''))"
    says = [
        (f"contains({a}, 'public decency')", L.CONTEXT_DECENCY),
        (f"contains({a}, 'permit') AND contains({a}, 'required')", L.CONTEXT_PERMIT),
        (f"contains({a}, 'zoning')", L.CONTEXT_ZONING),
        (f"NOT contains({a}, 'prohibited') AND NOT contains({a}, 'allowed')", L.CONTEXT_SILENT),
    ]
    parts = [_case(q, L.TOPIC_SEARCHES, _list)] + [f"CASE WHEN {t} THEN {_list(v)} ELSE []::VARCHAR[] END" for t, v in says]
    return "(" + " || ".join(parts) + ")[1:4]"


def _quick_terms(a: str, q: str) -> str:
    low = f"lower(coalesce({q}, ''))"
    return f"((regexp_extract_all({a}, '{_REF}', 1))[1:2] || {_case(low, L.QUICK_TOPICS, lambda v: _list([v]))})[1:3]"


QA = "FROM questions q JOIN answers a ON q.question_id = a.question_id"
PROMPT = "'Answer the question from the sections below and cite their numbers. Say which further sections are needed if these do not suffice.' || chr(10) || chr(10) || 'Question: ' || q.question || chr(10) || chr(10) || 'Sections:' || chr(10) || c.context || chr(10) || chr(10) || 'Answer:'"

KNN = """SELECT query_id, vec_id, dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS dist
   FROM embeddings q, embeddings e WHERE {where})) WHERE rank <= {k}"""

DESCRIBE = """ds AS (SELECT t.source, count(d.source) AS n_docs, CASE WHEN count(d.source) > 0 THEN 'POPULATED' ELSE 'EMPTY' END AS status, min(d.section) AS sample_section,
  arg_min(left(d.content, 100), (d.section, left(d.content, 100))) AS sample_content FROM mix_targets t
  LEFT JOIN (SELECT source, coalesce(section, 'none') AS section, text AS content FROM documents) d ON d.source = t.source GROUP BY ALL)"""

_EXTRACT = "left({c}, 200) || CASE WHEN {id} % 3 = 0 THEN ' I would need to see additional information on the permit.' ELSE '' END"
_FAILS = "question_id % 11 = 0"

ASK = f"""WITH {_smart(12)}, {_self_query('ex0')},
fc AS (SELECT s.question_id, s.rank, s.section, d.text AS content FROM sq s JOIN documents d ON d.doc_id = s.doc_id
  WHERE (SELECT count(*) FROM sm WHERE sm.question_id = s.question_id) < 5 AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.question_id = s.question_id AND sm.section IS NOT DISTINCT FROM s.section)),
dc AS (SELECT * FROM (SELECT question_id, section, content, row_number() OVER (PARTITION BY question_id ORDER BY part, rank, section, content) AS rank FROM
  (SELECT question_id, rank, section, content, 0 AS part FROM sm UNION ALL BY NAME SELECT question_id, rank, section, content, 1 AS part FROM fc)) WHERE rank <= 12),
{_context('c1', 'dc')},
a1 AS (SELECT question_id, CASE WHEN NOT {_FAILS} THEN {_EXTRACT.format(c='context', id='question_id')} END AS answer, {_FAILS} AS failed FROM c1),
mo AS (SELECT a1.*, x.question FROM a1 JOIN ex0 x ON a1.question_id = x.question_id WHERE {_any("lower(coalesce(answer, ''))", L.NEEDS_MORE)}),
te0 AS (SELECT question_id, {_quick_terms('answer', 'question')} AS ts FROM mo),
te AS (SELECT question_id, (i - 1)::INT AS term_ord, 2 AS k FROM te0, unnest(range(1, len(ts) + 1)) AS u(i)),
{_hits('h2', 'te', 'term_ord', 'q.question_id * 7 + q.term_ord + 3')},
{_first('f2', 'h2', 'term_ord')},
nw AS (SELECT * FROM (SELECT question_id, first_seen AS rank, section, content, row_number() OVER (PARTITION BY question_id, section ORDER BY first_seen) AS n FROM f2
  WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.question_id = f2.question_id AND dc.section IS NOT DISTINCT FROM f2.section)) WHERE n = 1),
al AS (SELECT question_id, section, content, row_number() OVER (PARTITION BY question_id ORDER BY part, rank) AS rank FROM
  (SELECT question_id, rank, section, content, 0 AS part FROM dc UNION ALL BY NAME SELECT question_id, rank, section, content, 1 AS part FROM nw)),
ml AS (SELECT * FROM al WHERE question_id IN (SELECT question_id FROM nw)),
{_context('c2', 'ml')},
a2 AS (SELECT question_id, {_EXTRACT.format(c='context', id='question_id')} AS answer_2 FROM c2),
n1 AS (SELECT question_id, count(*) AS n, md5(string_agg(coalesce(section, '-') || ':' || content, '|' ORDER BY rank)) AS m FROM al GROUP BY ALL)
SELECT x.question_id, n1.n IS NOT NULL AND NOT failed AS success, coalesce(n1.n, 0)::INT AS n_documents, coalesce(n1.m, md5('')) AS documents_md5, coalesce(answer_2, answer) AS answer,
  CASE WHEN n1.n IS NULL THEN 'No relevant documents found' WHEN failed THEN 'Error generating response: model unavailable' END AS error, CASE WHEN n1.n IS NULL THEN 0 WHEN answer_2 IS NOT NULL THEN 2 ELSE 1 END::INT AS iterations,
  CASE WHEN n1.n IS NOT NULL AND NOT failed AND answer_2 IS NULL AND {_any("lower(coalesce(answer, ''))", L.NEEDS_MORE)} THEN 'Comprehensive search completed' END AS note
FROM ex0 x LEFT JOIN a1 ON x.question_id = a1.question_id LEFT JOIN a2 ON x.question_id = a2.question_id LEFT JOIN n1 ON x.question_id = n1.question_id"""

SQL = {
    "page_ranges": """WITH p AS (SELECT source, max(page) AS pages FROM ocr_elements WHERE source IS NOT NULL GROUP BY ALL),
r AS (SELECT source, i::INT AS range_no, (i * ceil(pages / 8.0) + 1)::INT AS start_page, least((i + 1) * ceil(pages / 8.0), pages)::INT AS end_page FROM p, range(8) AS u(i))
SELECT * FROM r WHERE start_page <= end_page""",
    "page_elements": f"WITH {ELEMENTS} SELECT source, page, elem_no, text FROM el",
    "sections_inline": INLINE + "SELECT * FROM secs",
    "sections_inline_valid": INLINE + "SELECT * FROM secs WHERE length(content) > 100",
    "sections_lines": LINES + "SELECT * FROM secs",
    "sections_lines_valid": LINES + "SELECT * FROM secs WHERE length(content) > 50",
    "section_counts": LINES + "SELECT source, count(*) AS n_sections, count(*) FILTER (length(content) > 50) AS n_valid FROM secs GROUP BY ALL",
    "fallback_label": r"""SELECT parent_key, coalesce(nullif(regexp_extract(page_content, '(\d+\.\d+\.\d+)', 1), ''), 'chunk_' || CASE WHEN parent_key < 10000 THEN lpad(parent_key::VARCHAR, 4, '0') ELSE parent_key::VARCHAR END) AS label
FROM parent_docs WHERE page_content IS NOT NULL""",
    "parent_lookup": f"SELECT parent_key, section, length(page_content)::INT AS parent_chars, TRUE AS holds_chunks FROM parent_docs WHERE {_strip('page_content')} <> ''",
    "fallback_sources": LINES + """, n AS (SELECT source, count(*) FILTER (length(content) > 50) AS n_valid FROM secs GROUP BY ALL),
e AS (SELECT DISTINCT source FROM ocr_elements WHERE source IS NOT NULL AND text IS NOT NULL)
SELECT e.source, coalesce(n_valid, 0) AS n_valid, coalesce(n_valid, 0) < 10 AS falls_back FROM e LEFT JOIN n ON e.source = n.source""",
    "filter_scan": "SELECT doc_id, section, source FROM documents WHERE section >= '20.' OR (source IN ('larkmoor-code', 'saltmere-code') AND NOT section = '7.04.010')",
    "load_batches": """SELECT batch_no, count(*) AS n_docs, count(*) AS n_written, TRUE AS ok, 'Batch ' || (batch_no + 1) || ' (' || count(*) || ' docs) added' AS message FROM
(SELECT ((row_number() OVER (ORDER BY parent_key) - 1) // 50)::BIGINT AS batch_no FROM parent_docs WHERE page_content IS NOT NULL) GROUP BY batch_no""",
    "clock": "SELECT question_id, strftime(asked_at, '%H:%M:%S') AS asked FROM questions",
    "section_refs": f"SELECT question_id, array_to_string(regexp_extract_all(answer, '{_REF}', 1), '|') AS refs FROM answers WHERE answer IS NOT NULL",
    "section_refs_all": f"SELECT doc_id, array_to_string({_refs_all('text')}, '|') AS refs FROM documents",
    "search_terms": f"""SELECT question_id, array_to_string(list_filter(list_transform(regexp_extract_all(reply, '(?i)search:{_SP}*([^\\n]+)', 1), lambda t: {_strip('t')}), lambda t: t <> ''), '|') AS terms
FROM (SELECT question_id, string_agg('Search: ' || query, chr(10) ORDER BY query_ord) AS reply FROM search_queries WHERE query IS NOT NULL GROUP BY ALL)""",
    "topic_flags": "SELECT question_id, " + ", ".join(f"{_any('lower(question)', t)} AS topic_{i}" for i, (t, _) in enumerate(L.QUESTION_TOPICS, 1)) + " FROM questions WHERE question IS NOT NULL",
    "needs_more": "SELECT question_id, " + _any("lower(coalesce(answer, ''))", L.NEEDS_MORE) + " AS needs_more FROM answers",
    "needs_more_strict": "SELECT question_id, " + _any("lower(coalesce(answer, ''))", L.NEEDS_MORE_STRICT) + " AS needs_more FROM answers",
    "section_bonus": f"SELECT ordinal, ({_section_bonus('section')})::INT AS bonus FROM sections",
    "quality_bonus": f"SELECT ordinal, {_quality_bonus('content')}::INT AS bonus FROM sections",
    "word_match": ANSWERED + f" SELECT question_id, ord, {_word_match('question', 'content')}::INT AS n_words FROM an",
    "relevance": ANSWERED + f" SELECT question_id, ord, {_relevance('question', 'section', 'content')} AS score FROM an",
    "expand_queries": f"WITH {_expand(12)} SELECT question_id, query_ord, query, k FROM ex",
    "topic_searches": f"SELECT q.question_id, array_to_string({_topic_searches('q.question', 'a.answer')}, '|') AS searches {QA}",
    "quick_terms": f"SELECT q.question_id, array_to_string({_quick_terms('a.answer', 'q.question')}, '|') AS terms {QA} WHERE q.question IS NOT NULL AND a.answer IS NOT NULL",
    "extra_terms": f"""WITH t AS (SELECT q.question_id, {_refs_all('a.answer')} || {_topic_searches('q.question', 'a.answer')} || ['Noise Ordinance', 'appeal deadline'] AS ts {QA}),
u AS (SELECT question_id, ts[i] AS t, i FROM t, unnest(range(1, len(ts) + 1)) AS u(i)),
f AS (SELECT question_id, t, i FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(t) ORDER BY i) AS n FROM u) WHERE n = 1)
SELECT question_id, array_to_string((list(t ORDER BY i))[1:5], '|') AS terms FROM f GROUP BY ALL""",
    "dedup_terms": """SELECT question_id, query_ord, query FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(query) ORDER BY query_ord) AS n FROM search_queries WHERE query IS NOT NULL) WHERE n = 1""",
    "index_scan": f"WITH {INDEX} SELECT doc_id, section, content FROM idx WHERE source = 'larkmoor-code'",
    "index_stats": f"WITH {INDEX} SELECT source, count(*) AS n_docs FROM idx GROUP BY ALL",
    "documents_projection": "SELECT ordinal, section, content, 'code_of_ordinances.pdf' AS doc_source FROM sections WHERE content IS NOT NULL",
    "index_describe": f"WITH {DESCRIBE} SELECT * FROM ds",
    "populated": f"WITH {DESCRIBE} SELECT source, n_docs FROM ds WHERE n_docs > 0",
    "batches": "SELECT ordinal, ((row_number() OVER (ORDER BY ordinal) - 1) // 50)::BIGINT AS batch_no FROM sections",
    "batch_report": """SELECT batch_no, count(*) AS n_docs, bool_and(ok) AS ok, count(*) FILTER (NOT ok) AS n_failed FROM
(SELECT ((row_number() OVER (ORDER BY ordinal) - 1) // 50)::BIGINT AS batch_no, content IS NOT NULL AS ok FROM sections) GROUP BY ALL""",
    "knn": KNN.format(where="q.vec_id % 20 = 0", k=12),
    "knn_single": KNN.format(where="q.vec_id = 0", k=3),
    "batch_search": f"""WITH {INDEX}, sq AS (SELECT * FROM search_queries WHERE query IS NOT NULL),
{_hits('h', 'sq', 'query_ord', 'q.question_id * 6 + q.query_ord')}, {_first('f', 'h', 'query_ord')} SELECT question_id, query_ord, rank::INT AS rank, doc_id, first_seen::INT AS first_seen FROM f""",
    "smart_search": f"WITH {_smart(12)} SELECT question_id, rank, doc_id, score FROM sm",
    "search_legacy": f"WITH {_smart(8)} SELECT question_id, rank, doc_id, score FROM sm",
    "self_query": f"WITH {ANSWER_Q}, {_self_query('aq')} SELECT question_id, doc_id, section, rank::INT AS rank FROM sq",
    "debug_search": f"""WITH {INDEX}, qq AS (SELECT question_id, question FROM questions WHERE question IS NOT NULL), {_self_query('qq')},
rs AS (SELECT question_id, 0 AS query_ord, 5 AS k FROM qq WHERE question_id NOT IN (SELECT question_id FROM sq)),
{_hits('h', 'rs', 'query_ord', 'q.question_id * 6')}
SELECT question_id, doc_id, rank::INT AS rank, 'filter' AS path FROM sq UNION ALL SELECT question_id, doc_id, rank::INT, 'search' FROM h WHERE rank <= 2""",
    "index_verify": f"WITH {INDEX}, s AS ({KNN.format(where='q.vec_id = 0', k=3)}) SELECT (SELECT count(*) FROM idx) AS n_docs, (SELECT string_agg(vec_id::VARCHAR, '|' ORDER BY rank) FROM s) AS sample_ids",
    "format_context": f"{ANSWERED}, dd AS (SELECT question_id, ord + 1 AS rank, section, content FROM an), {_context('c', 'dd')} SELECT * FROM c",
    "answer_prompt": f"{ANSWERED}, dd AS (SELECT question_id, ord + 1 AS rank, section, content FROM an), {_context('c', 'dd')} SELECT q.question_id, {PROMPT} AS prompt FROM questions q JOIN c ON q.question_id = c.question_id WHERE q.question IS NOT NULL",
    "fallback_merge": _merge(False, "coalesce(nd.c, 0) < 5 AND", "WHERE rank <= 12"),
    "second_pass_merge": _merge(True, "", ""),
    "ask_sql": ASK,
    "preview": "SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS shown FROM documents",
    "highlight": r"SELECT doc_id, regexp_replace(text, '(?i)\b(Section\s+\d+\.\d+\.\d+(?:\.\d+)*)\b', '[\1]', 'g') AS shown FROM documents",
    "strip_ansi": r"SELECT question_id, regexp_replace(chr(27) || '[1;34m' || question || chr(27) || '[0m', '\x1b\[[0-9;]*m', '', 'g') AS plain FROM questions WHERE question IS NOT NULL",
}
