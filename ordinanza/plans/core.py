"""Queries for the section, search and answer operators, one per operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import scores, text
from ..functions import lexicon as L
from ..operators import answer, chunks, context, index, ivf, models, search, sections, selfquery
from ..session import checkpoint_folder, cut

INLINE_MIN, LINES_MIN = 100, 50


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _join(c, sep: str = "|"):
    return F.array_join(c, sep)


# -- parsing ---------------------------------------------------------------

def page_ranges(s, d):
    docs = _t(s, d, "ocr_elements").where("source is not null").groupBy("source").agg(F.max("page").alias("pages"))
    return sources.page_ranges(docs, "pages", 8).select("source", "range_no", "start_page", "end_page")


def page_elements(s, d):
    return sources.elements_in_order(_t(s, d, "ocr_elements"))


def sections_inline(s, d, min_chars=None):
    return sections.split_inline(_t(s, d, "documents"), "doc_id", "text", min_chars)


def sections_inline_valid(s, d):
    return sections_inline(s, d, INLINE_MIN)


def sections_lines(s, d, min_chars=None):
    e = sources.elements_in_order(_t(s, d, "ocr_elements").where("source is not null and text is not null"))
    return sections.split_lines(e, "source", "page", ["elem_no"], "text", min_chars)


def sections_lines_valid(s, d):
    return sections_lines(s, d, LINES_MIN)


def section_counts(s, d):
    x = sections_lines(s, d)
    return x.groupBy("source").agg(F.count("*").alias("n_sections"), F.count_if(F.length("content") > LINES_MIN).alias("n_valid"))


def fallback_label(s, d):
    p = _t(s, d, "parent_docs").where("page_content is not null")
    return p.select("parent_key", sections.fallback_label(F.col("page_content"), F.col("parent_key")).alias("label"))


def fallback_chunks(s, d):
    """Sources with fewer than 10 valid sections, or none at all, are chunked whole at 1000 characters instead, each chunk labelled."""
    e = _t(s, d, "ocr_elements").where("source is not null and text is not null")
    few = e.select("source").distinct().join(section_counts(s, d), "source", "left").where("coalesce(n_valid, 0) < 10").select("source")
    e = sources.elements_in_order(e.join(few, "source"))
    pages = e.groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    c = chunks.expand_pages(pages, "source", "page", "t", size=1000, overlap=200)
    return c.withColumn("label", sections.fallback_label(F.col("chunk"), F.col("chunk_no")))


def chunk_rows(s, d):
    return chunks.expand_children(_t(s, d, "parent_docs"), "parent_key", "page_content").select("parent_key", "chunk_no", "chunk")


def parent_child(s, d):
    c = chunks.expand_children(_t(s, d, "parent_docs"), "parent_key", "page_content", "section", "source")
    return c.withColumn("chunk_id", F.sha2(F.concat_ws(":", "parent_key", "chunk_no"), 256))


def parent_lookup(s, d):
    """The chunks of all parents brought back to them by an equi-join: whether each parent holds every one of its chunks."""
    p = _t(s, d, "parent_docs")
    kids = chunks.expand_children(p, "parent_key", "page_content").select(F.col("parent_key").alias("parent_id"), "chunk")
    j = kids.join(p, kids.parent_id == p.parent_key).select("parent_key", "section", F.length("page_content").alias("parent_chars"), F.col("page_content").contains(F.col("chunk")).alias("_in"))
    return j.groupBy("parent_key").agg(F.first("section").alias("section"), F.first("parent_chars").alias("parent_chars"), F.bool_and("_in").alias("holds_chunks"))


def fallback_sources(s, d):
    """Every source, also one without any section, with its valid sections and whether it is chunked whole instead."""
    e = _t(s, d, "ocr_elements").where("source is not null and text is not null").select("source").distinct()
    n = F.coalesce("n_valid", F.lit(0)).cast("long")
    return e.join(section_counts(s, d), "source", "left").select("source", n.alias("n_valid"), (n < 10).alias("falls_back"))


def section_refs(s, d):
    return _t(s, d, "answers").where("answer is not null").select("question_id", _join(scores.section_refs(F.col("answer"))).alias("refs"))


def section_refs_all(s, d):
    return _t(s, d, "documents").select("doc_id", _join(scores.section_refs_all(F.col("text"))).alias("refs"))


def search_terms(s, d):
    q = _t(s, d, "search_queries").where("query is not null").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("query_ord", "query"))).alias("qs"))
    out = q.withColumn("reply", F.array_join(F.transform("qs", lambda x: F.concat(F.lit("Search: "), x["query"])), "\n"))
    return out.select("question_id", _join(scores.search_terms(F.col("reply"))).alias("terms"))


# -- predicates and scores ---------------------------------------------------

def topic_flags(s, d):
    q = _t(s, d, "questions").where("question is not null")
    low = F.lower("question")
    return q.select("question_id", *[text.contains_any(low, t).alias(f"topic_{i}") for i, (t, _) in enumerate(L.QUESTION_TOPICS, 1)])


def needs_more(s, d):
    return _t(s, d, "answers").select("question_id", scores.needs_more(F.col("answer")).alias("needs_more"))


def needs_more_strict(s, d):
    return _t(s, d, "answers").select("question_id", scores.needs_more(F.col("answer"), L.NEEDS_MORE_STRICT).alias("needs_more"))


def section_bonus(s, d):
    return _t(s, d, "sections").select("ordinal", scores.section_bonus(F.col("section")).cast("int").alias("bonus"))


def quality_bonus(s, d):
    return _t(s, d, "sections").select("ordinal", scores.quality_bonus(F.col("content")).cast("int").alias("bonus"))


def _answered(s, d):
    """(question_id, question, ord, section, content): the documents that came with each answer."""
    a = _t(s, d, "answers").select("question_id", F.posexplode("documents").alias("ord", "doc"))
    q = _t(s, d, "questions").select("question_id", "question")
    return a.join(q, "question_id").select("question_id", "question", "ord", F.col("doc.section").alias("section"), F.col("doc.content").alias("content"))


def word_match(s, d):
    return _answered(s, d).select("question_id", "ord", scores.word_match(F.col("question"), F.col("content")).alias("n_words"))


def relevance(s, d):
    return _answered(s, d).select("question_id", "ord", scores.relevance(F.col("question"), F.col("section"), F.col("content")).cast("int").alias("score"))


def expand_queries(s, d):
    return search.expand_questions(_t(s, d, "questions").select("question_id", "question"), 12).select("question_id", "query_ord", "query", "k")


def topic_searches(s, d):
    j = _t(s, d, "questions").join(_t(s, d, "answers").select("question_id", "answer"), "question_id")
    return j.select("question_id", _join(scores.topic_searches(F.col("question"), F.col("answer"))).alias("searches"))


def quick_terms(s, d):
    j = _t(s, d, "questions").where("question is not null").join(_t(s, d, "answers").where("answer is not null").select("question_id", "answer"), "question_id")
    return j.select("question_id", _join(scores.quick_terms(F.col("answer"), F.col("question"))).alias("terms"))


def extra_terms(s, d):
    j = _t(s, d, "questions").join(_t(s, d, "answers").select("question_id", "answer"), "question_id")
    return j.select("question_id", _join(scores.extra_terms(F.col("question"), F.col("answer"), F.lit("SEARCH: Noise Ordinance\nsearch: appeal deadline"))).alias("terms"))


def dedup_terms(s, d):
    """First of the queries of a question that differ only in letter case."""
    q = _t(s, d, "search_queries").where("query is not null")
    w = Window.partitionBy("question_id", F.lower("query")).orderBy("query_ord")
    return q.withColumn("n", F.row_number().over(w)).where("n = 1").select("question_id", "query_ord", "query")


# -- index and search --------------------------------------------------------

def index_rows(s, d):
    """The searchable index: documents that have a vector."""
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _t(s, d, "documents").select("doc_id", "section", F.col("text").alias("content"), "source").join(e, "doc_id")


def _folder(s) -> str:
    return f"{checkpoint_folder(s)}/index-{uuid.uuid4().hex}"


def index_scan(s, d):
    """One collection of a stored index, by a scan of its partition alone."""
    at = _folder(s)
    index_rows(s, d).where("source is not null").withColumn("collection", F.col("source")).write.partitionBy("collection").parquet(at)
    return index.read_index(s, at, "larkmoor-code").select("doc_id", "section", "content")


FILTER = '{"or": [{"gte": ["section", "20."]}, {"and": [{"in": ["source", ["larkmoor-code", "saltmere-code"]]}, {"not": {"eq": ["section", "7.04.010"]}}]}]}'


def filter_scan(s, d):
    """Documents that a structured filter, as a model writes it, lets through; it reaches the scan as a predicate."""
    return _t(s, d, "documents").where(selfquery.compile_filter(FILTER)).select("doc_id", "section", "source")


def load_batches(s, d):
    """Parents and embedded children written to a store, with the outcome of every batch of 50."""
    return index.load_index(_t(s, d, "parent_docs"), _folder(s), "parents", models.embed, key="parent_key", text="page_content").drop("n_chunks")


def search_texts(s, d):
    """All questions searched by the embeddings of their texts in a stored index of all documents' chunks."""
    at = _folder(s)
    index.load_index(_t(s, d, "documents"), at, "documents", models.embed, key="doc_id", text="text")
    q = _t(s, d, "questions").where("question is not null").select("question_id", "question")
    return search.search_index(q, index.read_index(s, f"{at}/index", "documents"), 12, models.embed).drop("question", "content")


def index_stats(s, d):
    return index.stats(index_rows(s, d), "source")


def documents_projection(s, d):
    return _t(s, d, "sections").where("content is not null").select("ordinal", "section", "content", F.lit("code_of_ordinances.pdf").alias("doc_source"))


def index_describe(s, d):
    t = _t(s, d, "mix_targets").select("source")
    rows = t.join(_t(s, d, "documents").select("source", F.coalesce("section", F.lit("none")).alias("section"), F.col("text").alias("content")), "source", "left")
    return index.describe(rows, "source")


def populated(s, d):
    return index.populated(index_describe(s, d).withColumn("error", F.lit(None).cast("string"))).select("source", "n_docs")


def batches(s, d):
    return index.batches(_t(s, d, "sections"), "ordinal")


def batch_report(s, d):
    b = batches(s, d).join(_t(s, d, "sections").select("ordinal", "content"), "ordinal")
    return index.batch_report(b, "batch_no", F.col("content").isNotNull())


def _vector_queries(s, d):
    """Every vector whose id is divisible by 20, as the stated query set."""
    return _t(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def knn(s, d):
    e = _t(s, d, "embeddings")
    return search.knn(_vector_queries(s, d), e, query_id="query_id", item_id="vec_id", query_vector="query_vector", item_vector="embedding", k=12)


def knn_approx(s, d):
    """The queries of ``knn`` by an inverted index of all rows; as many cells are probed as 95 % recall takes."""
    e = _t(s, d, "embeddings")
    c = ivf.fit_centroids(e, "vec_id", "embedding")
    built = cut(ivf.build(e, "embedding", c))
    return ivf.search(_vector_queries(s, d), built, c, query_id="query_id", item_id="vec_id", query_vector="query_vector", item_vector="embedding", k=12, probes=ivf.probes_for(e, "vec_id", "embedding", c, 12))


def knn_single(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.knn(q, e, query_id="query_id", item_id="vec_id", query_vector="query_vector", item_vector="embedding", k=3)


def _vector_of(s, d, queries: DataFrame, slot) -> DataFrame:
    """Give each query the fixture vector with id slot % 500, which stands for its embedding."""
    v = _t(s, d, "embeddings").select(F.col("vec_id").alias("_vid"), F.col("embedding").alias("query_vector"))
    return queries.withColumn("_vid", F.pmod(slot, F.lit(500)).cast("long")).join(v, "_vid").drop("_vid")


def _search(s, d, queries: DataFrame, ords: list[str], k) -> DataFrame:
    """(question_id, ords, rank, doc_id, section, content): hits of every query."""
    q = queries.withColumn("query_id", F.struct("question_id", *ords).cast("string"))
    if isinstance(k, int):
        q = q.withColumn("k", F.lit(k))
    hits = search.knn(q, index_rows(s, d), query_id="query_id", item_id="doc_id", query_vector="query_vector", item_vector="embedding", k="k")
    texts = _t(s, d, "documents").select("doc_id", "section", F.col("text").alias("content"))
    return hits.join(q.drop("query_vector", "k"), "query_id").join(texts, "doc_id")


def _pass_one(s, d, k):
    q = search.expand_questions(_t(s, d, "questions").select("question_id", "question"), k)
    q = _vector_of(s, d, q, F.col("question_id") * 6 + F.col("query_ord"))
    hits = _search(s, d, q, ["query_ord"], "k")
    return search.first_wins(hits, "question_id", ["query_ord", "rank"], "content")


def batch_search(s, d):
    """Searches of the given query table, k of each, the first of repeated contents kept."""
    q = _vector_of(s, d, _t(s, d, "search_queries").where("query is not null"), F.col("question_id") * 6 + F.col("query_ord"))
    hits = search.first_wins(_search(s, d, q, ["query_ord"], "k"), "question_id", ["query_ord", "rank"], "content")
    return hits.select("question_id", "query_ord", "rank", "doc_id", "first_seen")


def smart(s, d, k):
    hits = _pass_one(s, d, k).drop("rank")
    return search.rerank(hits, "question_id", "question", k)


def smart_search(s, d):
    return smart(s, d, 12).select("question_id", "rank", "doc_id", "score")


def search_legacy(s, d):
    return smart(s, d, 8).select("question_id", "rank", "doc_id", "score")


def self_query(s, d):
    q = _t(s, d, "questions").select("question_id", "question")
    a = _t(s, d, "answers").where("answer is not null").select("question_id", F.col("answer").alias("question"))
    return selfquery.self_query(a.join(q.select("question_id"), "question_id"), _t(s, d, "documents"), "doc_id")


def debug_search(s, d):
    """Structured filter first; questions it gives nothing get the 2 best of a plain search with k = 5."""
    q = _t(s, d, "questions").where("question is not null").select("question_id", "question")
    exact = selfquery.self_query(q, _t(s, d, "documents"), "doc_id").select("question_id", "doc_id", "rank", F.lit("filter").alias("path"))
    rest = q.join(exact.select("question_id").distinct(), "question_id", "left_anti").withColumn("query_ord", F.lit(0))
    plain = _search(s, d, _vector_of(s, d, rest, F.col("question_id") * 6), ["query_ord"], 5).where("rank <= 2")
    return exact.unionByName(plain.select("question_id", "doc_id", "rank", F.lit("search").alias("path")))


def index_verify(s, d):
    n = index_rows(s, d).agg(F.count("*").alias("n_docs"))
    hits = knn_single(s, d).groupBy().agg(_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string"))).alias("sample_ids"))
    return n.withColumn("one", F.lit(1)).join(hits.withColumn("one", F.lit(1)), "one").drop("one")


# -- answers -----------------------------------------------------------------

def format_context(s, d):
    docs = _answered(s, d).withColumn("rank", F.col("ord") + 1)
    return context.format_context(docs, "question_id")


def answer_prompt(s, d):
    q = _t(s, d, "questions").where("question is not null").select("question_id", "question")
    return q.join(format_context(s, d), "question_id").select("question_id", context.answer_prompt(F.col("question"), F.col("context")).alias("prompt"))


def answers(s, d):
    return answer_prompt(s, d).select("question_id", models.generate(F.col("prompt")).alias("r")).select("question_id", "r.answer", "r.error")


def embed(s, d):
    v = models.embed(F.col("question"))
    return _t(s, d, "questions").where("question is not null").select("question_id", v.alias("embedding"))


def _first_docs(s, d):
    return _answered(s, d).select("question_id", (F.col("ord") + 1).alias("rank"), "section", "content")


def fallback_merge(s, d):
    fb = self_query(s, d).join(_t(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    out = answer.fallback_merge(_first_docs(s, d), fb, "question_id")
    return out.select("question_id", "rank", "section", F.md5("content").alias("content_md5"))


def second_pass_merge(s, d):
    fb = self_query(s, d).join(_t(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    out = answer.second_pass_merge(_first_docs(s, d), fb, "question_id")
    return out.select("question_id", "rank", "section", F.md5("content").alias("content_md5"))


def _ask(s, d, generate):
    q = _t(s, d, "questions").where("question is not null").select("question_id", "question")
    docs = cut(smart(s, d, 12).select("question_id", "rank", "section", "content", "doc_id"))

    def second(terms: DataFrame) -> DataFrame:
        t = _vector_of(s, d, terms, F.col("question_id") * 7 + F.col("term_ord") + 3)
        hits = search.first_wins(_search(s, d, t, ["term_ord"], 2), "question_id", ["term_ord", "rank"], "content")
        return hits.select("question_id", F.col("first_seen").alias("rank"), "section", "content")

    fb = selfquery.self_query(q, _t(s, d, "documents"), "doc_id").join(_t(s, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return answer.ask(q, docs, second, generate, cut, fb)


def ask_sql(s, d):
    parts = F.transform("documents", lambda x: F.concat(F.coalesce(x["section"], F.lit("-")), F.lit(":"), x["content"]))
    return _ask(s, d, lambda i, _prompt, ctx: models.extractive(i, ctx)).withColumn("documents_md5", F.md5(F.array_join(parts, "|"))).drop("documents")


def ask(s, d):
    return _ask(s, d, lambda _id, prompt, _ctx: models.generate(prompt))


# -- display -----------------------------------------------------------------

def preview(s, d):
    return _t(s, d, "documents").select("doc_id", text.preview(F.col("text"), 600).alias("shown"))


def highlight(s, d):
    return _t(s, d, "documents").select("doc_id", text.highlight(F.col("text")).alias("shown"))


def strip_ansi(s, d):
    x = _t(s, d, "questions").where("question is not null")
    return x.select("question_id", text.strip_ansi(F.concat(F.lit("\x1b[1;34m"), F.col("question"), F.lit("\x1b[0m"))).alias("plain"))


def clock(s, d):
    return _t(s, d, "questions").select("question_id", text.clock(F.col("asked_at")).alias("asked"))


def wrapped(s, d):
    return _t(s, d, "questions").where("question is not null").select("question_id", _join(text.wrap(F.col("question"), 40), "\n").alias("wrapped"))


NAMES = {
    f.__name__: f
    for f in (
        page_ranges, page_elements, sections_inline, sections_inline_valid, sections_lines, sections_lines_valid, section_counts, fallback_label,
        fallback_chunks, fallback_sources, parent_child, parent_lookup, section_refs, section_refs_all, search_terms, topic_flags, needs_more, needs_more_strict,
        section_bonus, quality_bonus, word_match, relevance, expand_queries, topic_searches, quick_terms, extra_terms, dedup_terms, index_scan, index_stats,
        documents_projection, index_describe, populated, batches, batch_report, knn, knn_approx, knn_single, batch_search, smart_search, search_legacy, self_query,
        debug_search, index_verify, format_context, answer_prompt, answers, embed, fallback_merge, second_pass_merge, ask_sql, ask, filter_scan, load_batches, search_texts, clock, preview, highlight, strip_ansi,
    )
} | {"chunks": chunk_rows, "wrap": wrapped}
