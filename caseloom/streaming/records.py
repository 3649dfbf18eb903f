"""Records as they arrive: incremental stores, running summaries, usage accounting, one verdict a question.

Timestamps without a zone can't carry a watermark; they are cast first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas


def stream_records(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Records of a folder that runs append to, as a stream, flat."""
    read = spark.readStream.schema(schemas.RECORD)
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    r = read.json(folder).where("run is not null")
    return r.select(F.col("run.caseId").alias("case_id"), F.col("run.system").alias("system"), F.col("run.repetition").alias("repetition"), F.col("run.error").alias("error"), F.col("run.modelCalls").alias("model_calls"), F.col("run.tokensIn").alias("tokens_in"), F.col("run.tokensOut").alias("tokens_out"), F.col("run.costUsd").alias("cost_usd"), "grades", "status")


def store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every batch as Parquet; a batch that is repeated after a failure replaces itself, so each record is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_usage(stream: DataFrame) -> DataFrame:
    """Per system: records, failed ones, calls, tokens and cost so far (a stateful aggregation)."""
    return stream.groupBy("system").agg(
        F.count("*").alias("records"), F.sum(F.when(F.coalesce("error", F.lit("")) != "", 1).otherwise(0)).alias("failed"), F.sum("model_calls").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"),
    )


def running_rates(stream: DataFrame) -> DataFrame:
    """Per system and grader: grades, pass rate, mean score so far."""
    g = stream.select("system", F.explode("grades").alias("g"))
    return g.groupBy("system", F.col("g.grader").alias("grader")).agg(F.count("*").alias("n"), F.avg(F.col("g.pass").cast("int")).alias("pass_rate"), F.avg("g.score").alias("mean_score"))


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each record once, however often it arrives."""
    return stream.dropDuplicates(keys)


def windowed_counts(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Records per time window, late ones up to `late` counted."""
    e = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return e.groupBy(F.window("__t", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
