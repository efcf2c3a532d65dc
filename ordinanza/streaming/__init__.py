"""Streaming hooks: questions as they arrive and an index that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXIT_WORDS = ("exit", "quit")


def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One question per line of text files as they appear; exit commands are left out."""
    lines = spark.readStream.text(folder)
    return lines.where(~F.lower("value").isin(*EXIT_WORDS)).select(F.xxhash64("value").alias("question_id"), F.col("value").alias("question"))


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Answer every micro-batch with the batch engine and append the rows; a
    replayed batch overwrites its own folder, so a restart repeats nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(chunks: DataFrame, key: str, time: str, delay: str, out: str, checkpoint: str):
    """Append chunks that were not seen within the watermark; state is bounded by ``delay``."""
    fresh = chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
