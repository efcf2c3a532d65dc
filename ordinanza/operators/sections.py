"""Section parsing: text to (section, content) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SECTION_INLINE, SECTION_LINE, strip


def split_inline(df: DataFrame, key: str, text: str, min_chars: int | None = None) -> DataFrame:
    """Cut every text at each section number inside it: (key, ordinal, section, content).

    What precedes the first number is dropped; the content excludes the number.
    ``min_chars`` keeps contents longer than that, unstripped.  Null or empty
    texts give no rows.  Row-local: no shuffle.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(SECTION_INLINE), 1)
    bodies = F.split(F.col(text), SECTION_INLINE)
    pairs = F.arrays_zip(numbers.alias("section"), F.slice(bodies, 2, F.greatest(F.size(numbers), F.lit(0))).alias("content"))
    out = (
        df.where(F.col(text).rlike(SECTION_INLINE))
        .select(F.col(key), F.posexplode(pairs).alias("ordinal", "_p"))
        .select(key, "ordinal", F.col("_p.section").alias("section"), F.col("_p.content").alias("content"))
    )
    return out if min_chars is None else out.where(F.length("content") > min_chars)


def split_lines(lines: DataFrame, doc: str, page: str, pos: list[str], text: str, min_chars: int | None = None) -> DataFrame:
    """Line state machine over the lines of a document: (doc, header_no, section, content).

    A stripped line that begins with a section number opens a section, other
    lines append, blank lines and those before the first number are dropped.
    The running header number is a page-local count plus the prefix sum of the
    page totals, so no task ever holds the lines of a whole document; only a
    section's own lines meet, in the value that is returned.  Null documents
    form one document of their own.
    """
    ls = lines.select(doc, page, *pos, strip(F.col(text)).alias("_line")).where(F.col("_line") != "")
    ls = ls.withColumn("_num", F.regexp_extract("_line", SECTION_LINE, 1)).withColumn("_h", (F.col("_num") != "").cast("int"))
    totals = ls.groupBy(doc, page).agg(F.sum("_h").alias("_n"))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(doc).alias("_d"), F.col(page).alias("_pg"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(doc, page).orderBy(*pos).rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("_local", F.sum("_h").over(local))
    ls = ls.join(totals, F.col(doc).eqNullSafe(F.col("_d")) & F.col(page).eqNullSafe(F.col("_pg")))
    ls = ls.withColumn("header_no", F.col("_base") + F.col("_local")).where("header_no > 0")
    parts = F.array_sort(F.collect_list(F.struct(page, *pos, "_line")))
    out = ls.groupBy(doc, "header_no").agg(F.max("_num").alias("section"), F.array_join(F.transform(parts, lambda s: s["_line"]), "\n").alias("content"))
    return out if min_chars is None else out.where(F.length("content") > min_chars)


def fallback_label(content: Column, index: Column) -> Column:
    """The first section number anywhere in a chunk, else chunk_NNNN."""
    found = F.regexp_extract(content, r"(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("chunk_"), F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))))
