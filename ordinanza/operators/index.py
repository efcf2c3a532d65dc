"""The Parquet index: write, read, describe, verify."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources import exists
from .chunks import expand_children
from .search import knn


def write_index(chunks: DataFrame, path: str, collection: str, mode: str = "overwrite") -> None:
    """One distributed write, partitioned by collection; other collections stay.

    A single collection is one partition value, so files follow the tasks and no
    shuffle is needed.
    """
    chunks.withColumn("collection", F.lit(collection)).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("collection").parquet(path)


def read_index(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Partition-pruned scan of one collection."""
    return spark.read.parquet(path).where(F.col("collection") == collection)


def stats(index: DataFrame, *keys: str) -> DataFrame:
    return index.groupBy(*keys).agg(F.count("*").alias("n_docs"))


def populated(report: DataFrame) -> DataFrame:
    return report.where((F.col("n_docs") > 0) & F.col("error").isNull())


def batches(df: DataFrame, key: str, size: int = 50) -> DataFrame:
    """(key, batch_no): rows in key order, ``size`` per batch, without one task seeing all rows.

    Rows are range-partitioned by the key, which is materialised once, and
    numbered inside their partition; the partition offsets, one row per
    partition, are added by a join.
    """
    part = cut(df.select(key).repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    part = part.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    n = part.groupBy("_p").agg(F.count("*").alias("_n"), F.min(key).alias("_lo"))
    before = Window.partitionBy(F.lit(0)).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return part.join(n, "_p").select(key, F.floor((F.col("_i") + F.col("_off")) / size).cast("long").alias("batch_no"))


def _batch_of(docs: DataFrame, key: str, size: int) -> Column:
    """The batch of a row by its key, from the first key of every batch, of which there is one for ``size`` rows; texts are not shuffled for it."""
    first = batches(docs, key, size).groupBy("batch_no").agg(F.min(key).alias("k")).where("k is not null").orderBy("k", "batch_no").toPandas()
    held = docs.sparkSession.sparkContext.broadcast((first["k"].to_numpy(), first["batch_no"].to_numpy()))

    @F.pandas_udf("long")
    def run(k: pd.Series) -> pd.Series:
        starts, no = held.value
        return pd.Series(no[np.searchsorted(starts, k.to_numpy(), side="right") - 1])

    return run(F.col(key))


def load_index(parents: DataFrame, path: str, collection: str, embed, *, key: str, text: str, section: str = "section", size: int = 50) -> DataFrame:
    """Write parents, their children with vectors, and return the outcome per batch.

    Below ``path``, ``parents`` holds (parent_id, section, content, batch_no)
    and ``index`` (chunk_id, parent_id, chunk_no, section, content, embedding),
    both partitioned by collection.  The outcome, (batch_no, n_docs, n_written,
    n_chunks, ok, message), compares the batches asked for with what the store
    holds after the write.  Parents without text are no documents; a parent whose
    text the model cannot embed is stored, but its batch is not ok.
    """
    spark = parents.sparkSession
    docs = parents.where(F.col(text).isNotNull()).select(F.col(key).alias("parent_id"), F.col(section).alias("section"), F.col(text).alias("content"))
    docs = docs.where("parent_id is not null").withColumn("batch_no", _batch_of(docs, "parent_id", size))
    write_index(docs, f"{path}/parents", collection)
    kept = read_index(spark, f"{path}/parents", collection)
    kids = expand_children(kept, "parent_id", "content", "section", "batch_no")
    kids = kids.select(F.sha2(F.concat_ws(":", "parent_id", "chunk_no"), 256).alias("chunk_id"), "parent_id", "chunk_no", "section", F.col("chunk").alias("content"), "batch_no")
    write_index(kids.withColumn("embedding", embed(F.col("content"))), f"{path}/index", collection)
    asked = docs.groupBy("batch_no").agg(F.count("*").alias("n_docs"))
    written = kept.groupBy("batch_no").agg(F.count("*").alias("n_written"))
    chunks = read_index(spark, f"{path}/index", collection).groupBy("batch_no").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_failed"))
    out = asked.join(written, "batch_no", "left").join(chunks, "batch_no", "left").na.fill(0)
    ok = (F.col("n_docs") == F.col("n_written")) & (F.col("n_failed") == 0)
    said = F.when(ok, F.format_string("Batch %d (%d docs) added", F.col("batch_no") + 1, "n_docs")).otherwise(F.format_string("Batch %d failed: %d of %d docs stored, %d chunks without vector", F.col("batch_no") + 1, "n_written", "n_docs", "n_failed"))
    return out.select("batch_no", "n_docs", "n_written", "n_chunks", ok.alias("ok"), said.alias("message"))


def parents_of(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Whole parents of chunk hits, each once per question at the best rank of its chunks."""
    best = hits.groupBy("question_id", "parent_id").agg(F.min("rank").alias("rank"))
    return best.join(parents.select("parent_id", "section", "content"), "parent_id")


def describe_path(spark: SparkSession, path: str, collection: str, embed, probe: str = "code") -> dict:
    """{path, n_docs, status, sample_section, sample_content, error} of one stored index; any failure becomes its text.

    The sample is the nearest chunk to ``probe``, its content cut at 100 characters.
    """
    got = {"path": path, "n_docs": 0, "status": "ERROR", "sample_section": None, "sample_content": None, "error": None}
    try:
        if not exists(spark, path):
            return got | {"error": "Directory does not exist"}
        index = read_index(spark, path, collection)
        n = index.count()
        if not n:
            return got | {"status": "EMPTY"}
        q = spark.range(1).select("id", embed(F.lit(probe)).alias("v"))
        hit = knn(q, index, query_id="id", item_id="chunk_id", query_vector="v", item_vector="embedding", k=1)
        row = hit.join(index, "chunk_id").select("section", F.left("content", F.lit(100)).alias("c")).first()
        return got | {"n_docs": n, "status": "POPULATED", "sample_section": row and row.section, "sample_content": row and row.c}
    except Exception as e:  # noqa: BLE001
        return got | {"error": str(e).split("\n")[0]}


def batch_report(df: DataFrame, batch: str, ok: Column) -> DataFrame:
    """Per batch: rows, whether every row loaded, and the number that failed."""
    return df.groupBy(batch).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"), F.count_if(~ok).alias("n_failed")
    )


def describe(index: DataFrame, key: str) -> DataFrame:
    """Per index: rows, EMPTY or POPULATED, and the smallest section with a 100-character preview."""
    first = F.min(F.struct(F.col("section").isNull().alias("_z"), "section", F.left(F.col("content"), F.lit(100)).alias("_c")))
    out = index.groupBy(key).agg(F.count("section").alias("n_docs"), first.alias("_f"))
    return out.select(
        key,
        "n_docs",
        F.when(F.col("n_docs") > 0, "POPULATED").otherwise("EMPTY").alias("status"),
        F.col("_f.section").alias("sample_section"),
        F.when(F.col("n_docs") > 0, F.col("_f._c")).alias("sample_content"),
    )
