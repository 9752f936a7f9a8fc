"""Scoring of predictions that arrive file by file, each item once, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeloom.runtime import salted_lookup, shared_dir


def stream_records(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def once(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once. Without event time the state holds every key; with it, keys older than the delay are forgotten."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Appends rows to files; the checkpoint makes a restart go on where it ended. Ends when all that is there is read."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def snapshot_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole aggregate after every batch, replacing the one before."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished record; keys are compared null-safe."""
    ids = done.select(F.col(key).alias("_done")).distinct()
    return items.join(ids, items[key].eqNullSafe(ids["_done"]), "left_anti")


def cached_or_open(queries: DataFrame, results: DataFrame, keys: list[str], only_success: bool = True) -> DataFrame:
    """queries with status cached or open, by whether a result (a successful one) exists. Null keys have none; heavy keys are salted."""
    usable = results.where("success") if only_success else results
    known = usable.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return salted_lookup(queries, known, keys).withColumn("status", F.when(F.col("_hit"), "cached").otherwise("open")).drop("_hit")


def smoothed_rate(df: DataFrame, by: str, time: str, order: str, alpha: float = 0.3) -> DataFrame:
    """(by, rate): exponential moving average of events per second over a key's batches, in time order.

    df: one row per key and batch with n events and its end time; the batches of a key are folded.
    """
    steps = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(time).cast("double").alias("t"), F.col("n").cast("double").alias("n")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("r"))
    fold = F.aggregate(
        "s", start,
        lambda acc, x: F.struct(
            x["t"].alias("t"),
            F.when(acc["t"].isNull() | (x["t"] <= acc["t"]), acc["r"]).when(acc["r"].isNull(), x["n"] / (x["t"] - acc["t"])).otherwise(alpha * x["n"] / (x["t"] - acc["t"]) + (1 - alpha) * acc["r"]).alias("r"),
        ),
    )
    return steps.select(by, fold["r"].alias("rate"))


def scored_by_stream(spark: SparkSession, path: str, schema, keys: list[str], metrics, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Runs a stream over what is there, each key once, into the shared folder, and gives metrics(rows).

    Without event_time and delay the state holds every key, as repeats may come at any time; with
    them it forgets keys older than the delay (see ``once``).
    """
    at = shared_dir(spark)
    append_to(once(stream_records(spark, path, schema), keys, event_time, delay), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return metrics(spark.read.schema(schema).parquet(f"{at}/rows"))
