"""Readers: page ranges, page elements, cached text, files and indexes on disk."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_ranges(docs: DataFrame, pages: str, parts: int) -> DataFrame:
    """Cut 1..pages of every document into at most ``parts`` ranges; ranges that would be empty are left out."""
    size = F.ceil(F.col(pages) / parts)
    d = docs.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_s", size)
    d = d.withColumn("start_page", (F.col("range_no") * F.col("_s") + 1).cast("int"))
    d = d.withColumn("end_page", F.least((F.col("range_no") + 1) * F.col("_s"), F.col(pages)).cast("int"))
    return d.where("start_page <= end_page").drop("_s")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of files below a folder; only the columns asked for are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def extract_elements(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """(path, page, elem_no, text, error) by a pluggable extractor; a file that
    fails gives one row with its error and no text, and no file is dropped silently."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, p, i, t, None) for i, (p, t) in enumerate(extractor(bytes(content)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "elem_no", "text", "error"]).astype({"page": "Int32", "elem_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, elem_no int, text string, error string")


def text_extractor(content: bytes) -> list[tuple[int, str]]:
    """Stand-in for OCR: pages are separated by form feeds, elements by line ends."""
    return [(n, line) for n, page in enumerate(content.decode("utf-8").split("\f"), 1) for line in page.split("\n") if line.strip()]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system exists."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def preflight(spark: SparkSession, needed: dict[str, str], settings: list[str] = ()) -> list[tuple[str, bool, str]]:
    """(what, ok, message) for every needed path and environment setting, before a job starts."""
    out = []
    for what, path in needed.items():
        ok = exists(spark, path)
        out.append((what, ok, "found" if ok else f"{what} not found at {path}"))
    for name in settings:
        ok = bool(os.environ.get(name))
        out.append((name, ok, "set" if ok else f"{name} not found in environment variables"))
    return out


_PAGE_OBJECT = re.compile(rb"/Type\s*/Page(?![\w])")
_PAGE_COUNT = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", re.S)


def count_pages(content: bytes) -> int:
    """Pages of a PDF file: the largest count of its page trees, else its page objects. Other files count form feeds."""
    if not content.startswith(b"%PDF"):
        return content.count(b"\f") + 1 if content else 0
    counts = [int(a or b) for a, b in _PAGE_COUNT.findall(content)]
    return max(counts) if counts else len(_PAGE_OBJECT.findall(content))


def page_counts(files: DataFrame, counter: Callable[[bytes], int] = count_pages) -> DataFrame:
    """(path, length, pages, error) of files; one that cannot be read has its error and no count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, n, content in zip(b["path"], b["length"], b["content"]):
                try:
                    rows.append((path, n, counter(bytes(content)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "length", "pages", "error"]).astype({"pages": "Int32"})

    return files.select("path", "length", "content").mapInPandas(run, "path string, length long, pages int, error string")


def load_pages(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str]]], width: int = 200) -> DataFrame:
    """(path, page, n_chars, text, preview, error): the elements of every page joined by line ends, with a preview."""
    e = extract_elements(files, extractor)
    parts = F.array_sort(F.collect_list(F.struct("elem_no", "text")))
    p = e.groupBy("path", "page").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n").alias("_t"), F.max("error").alias("error"))
    text = F.when(F.col("error").isNull(), F.col("_t"))
    return p.select("path", "page", F.length(text).alias("n_chars"), text.alias("text"), F.left(text, F.lit(width)).alias("preview"), "error")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Read-through Parquet cache of a costly result."""
    if not exists(spark, path + "/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_whole_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


# The word and the name patterns by which an index folder is known.
def discover_indexes(spark: SparkSession, root: str, word: str = "chroma", patterns: tuple[str, ...] = ("chroma_db*", "*chroma*", "db*")) -> list[str]:
    """Names of folders below a path of any Hadoop file system that look like an index: by word or by pattern, each once, sorted."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted({n for n in names if word in n.lower() or any(fnmatch.fnmatchcase(n, pat) for pat in patterns)})


def elements_in_order(elements: DataFrame) -> DataFrame:
    """The last load of every (source, page, elem_no, scanned_at) and the last scan of every page.

    Pages scanned again replace the earlier scan; rows delivered twice count once.
    """
    from pyspark.sql import Window

    last = elements.groupBy("source", "page").agg(F.max("scanned_at").alias("_s")).select(F.col("source").alias("_src"), F.col("page").alias("_pg"), "_s")
    now = elements.join(last, F.col("source").eqNullSafe(F.col("_src")) & F.col("page").eqNullSafe(F.col("_pg")) & F.col("scanned_at").eqNullSafe(F.col("_s")))
    w = Window.partitionBy("source", "page", "elem_no").orderBy(F.desc("loaded_at"), F.desc_nulls_last("text"))
    return now.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source", "page", "elem_no", "text")
