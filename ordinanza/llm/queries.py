"""The pN_ queries over the given tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies, leaks, mixing, pii, quality, scan_noise, site_lines, splitting, survivors
from .sql import SQL  # noqa: F401


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# -- 1 splitting ---------------------------------------------------------------

def p1_found(s, d):
    p = splitting.split_oversized(_t(s, d, "parent_docs"), "parent_key", "page_content", with_text=False)
    return p.where("oversized and piece_no = 0").select("parent_key", "cut_level")


def p1_pieces(s, d):
    return splitting.split_oversized(_t(s, d, "parent_docs"), "parent_key", "page_content")


# -- 2 best values ----------------------------------------------------------------

def p2_records(s, d):
    x, trust = _t(s, d, "sections"), _t(s, d, "source_trust").groupBy("source").agg(F.max("trust").alias("trust"))
    whole = survivors.whole_content(x, "ordinal", "provision_id", "content").select("ordinal", "whole")
    x = x.join(whole, "ordinal", "left").join(trust, "source", "left")
    x = x.withColumn("content_ok", F.coalesce("whole", F.lit(False))).withColumn("section_ok", survivors.section_ok(F.col("section")))
    return survivors.survivors(x, "ordinal", "provision_id", {"section": "section_ok", "content": "content_ok"}, "trust", "loaded_at")


def p2_found(s, d):
    return p2_records(s, d).select("provision_id", "field_name", "ordinal")


# -- 3 lines of the site -------------------------------------------------------

def p3_found(s, d):
    return site_lines.site_lines(_t(s, d, "parent_docs"), "parent_key", "source", "page_content").select("parent_key", "line_no")


def p3_templates(s, d):
    return site_lines.site_templates(_t(s, d, "parent_docs"), "parent_key", "source", "page_content")


def p3_cleaned(s, d):
    return site_lines.remove_site_lines(_t(s, d, "parent_docs"), "parent_key", "source", "page_content").select("parent_key", "page_content", "n_lines_removed")


# -- 4 copies in other form ------------------------------------------------------

def _long_sections(s, d):
    return _t(s, d, "sections").where(F.length(F.regexp_replace("content", copies.SPACE + "$|^" + copies.SPACE, "")) > 50)


def p4_found(s, d):
    c = copies.collapse(_long_sections(s, d), "ordinal", ["section", "content"], free_order=["content"])
    return c.where("n_copies > 1 and first_key < copy_key").select(F.col("first_key").alias("first_ordinal"), F.col("copy_key").alias("copy_ordinal"))


def p4_records(s, d):
    """One record per set of copies with the number of its copies, over all rows of any length."""
    x = _t(s, d, "sections")
    c = copies.collapse(x, "ordinal", ["section", "content"], free_order=["content"]).where("first_key = copy_key")
    return c.join(x.select("ordinal", "section", "content"), F.col("first_key") == F.col("ordinal")).select("ordinal", "section", "content", "n_copies")


# -- 5 quality of text ---------------------------------------------------------

def line_model(s, d):
    return quality.fit_lines(_t(s, d, "sections"), "ordinal", "content", _t(s, d, "quality_labels"))


def p5_found(s, d):
    k = quality.label_documents(_long_sections(s, d), "ordinal", "content", line_model(s, d))
    return k.where("kind <> 'prose'").select("ordinal", "kind")


def p5_labels(s, d):
    return quality.label_documents(_t(s, d, "sections"), "ordinal", "content", line_model(s, d))


def p5_statistics(s, d):
    common = quality.common_list(_t(s, d, "common_words"))
    return _t(s, d, "sections").where("content is not null").select("ordinal", *[c.alias(n) for n, c in quality.statistics(F.col("content"), common).items()])


# -- 6 noise of scanned pages ----------------------------------------------------

def _noise_model(s, d):
    return scan_noise.fit([(_t(s, d, "sections"), "content"), (_t(s, d, "parent_docs"), "page_content")])


def p6_found(s, d):
    m = _noise_model(s, d)
    sec = _t(s, d, "sections")
    a = scan_noise.find_noise(sec, "ordinal", "content", m)
    noisy = sec.join(a.select("ordinal").distinct(), "ordinal", "left_semi").where(F.length(F.trim("content")) > 50)
    junk = quality.label_documents(noisy, "ordinal", "content", line_model(s, d)).where("kind = 'junk'").select("ordinal")
    a = a.join(junk, "ordinal", "left_anti").select(F.lit("sections").alias("tbl"), F.col("ordinal").alias("rec_id"), "line_no", "kind")
    docs = _t(s, d, "parent_docs")
    b = scan_noise.find_noise(docs, "parent_key", "page_content", m)
    return a.unionByName(b.select(F.lit("parent_docs").alias("tbl"), F.col("parent_key").alias("rec_id"), "line_no", "kind"))


def p6_repaired(s, d):
    m = _noise_model(s, d)
    a = scan_noise.repair(_t(s, d, "sections"), "ordinal", "content", m)
    b = scan_noise.repair(_t(s, d, "parent_docs"), "parent_key", "page_content", m)
    names = ["rec_id", "text", "n_fixed"]
    return a.toDF(*names).withColumn("tbl", F.lit("sections")).unionByName(b.toDF(*names).withColumn("tbl", F.lit("parent_docs")))


# -- 7 leaked evaluation texts -----------------------------------------------------

def p7_leaks(s, d, paraphrase=None):
    return leaks.leaks(_t(s, d, "documents"), "doc_id", "text", _t(s, d, "eval_items"), "item_id", "item_text", paraphrase=paraphrase)


def p7_found(s, d):
    return p7_leaks(s, d).where("run_words >= 12").select("doc_id", "item_id")


def p7_paraphrases(s, d):
    return p7_leaks(s, d, 0.6)


# -- 8 mixing ------------------------------------------------------------------

def _mixed(s, d):
    docs = _t(s, d, "documents")
    sizes = mixing.count_tokens(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    return mixing.mix(sizes, _t(s, d, "mix_targets"), "doc_id")


def p8_mixture(s, d):
    return _mixed(s, d)[0]


def p8_shares(s, d):
    return _mixed(s, d)[1]


# -- 9 personal information ----------------------------------------------------

def p9_found(s, d):
    return pii.find_pii(_t(s, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p9_redacted(s, d):
    return pii.replace_pii(_t(s, d, "documents"), "doc_id", "text")


NAMES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_records, p3_found, p3_templates, p3_cleaned, p4_found, p4_records, p5_found, p5_labels, p5_statistics, p6_found, p6_repaired, p7_found, p7_paraphrases, p8_mixture, p8_shares, p9_found, p9_redacted)
}
