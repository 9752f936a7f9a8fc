"""Messages delivered more than once: one copy of each stays.

A ``MessageStore`` keeps, hash-bucketed and sorted by identifier, which delivery stands
for each message. Upserts add sorted runs to every bucket; compaction merges the runs
bucket by bucket, equal identifiers collapse to the smallest delivery, and the merged run
takes the place of the others. Both steps are idempotent: a batch that is written again
collapses with itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeloom.runtime import clean_id, delete, instant_micros, shared_dir, shuffle_partitions

RUNS = 8  # sorted runs that the batches of one load are spread over


class MessageStore:
    """Hash-bucketed, sorted runs of (identifier columns, delivery).

    buckets defaults to the session's shuffle partitions: the aggregation that collapses a
    batch then already places every identifier in the task of its bucket, so an upsert
    costs one shuffle of map-side combined rows, and a compaction costs none, because
    bucketed files are read in place. A message repeated in a third of all rows leaves
    each map task as one row. ``close`` drops the catalogue entry; the files go with the
    shared folder.
    """

    def __init__(self, spark, keys: list[str], delivery: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.keys, self.delivery = spark, list(keys), delivery
        self.buckets = buckets or shuffle_partitions(spark)
        self.path = path or shared_dir(spark)
        self.generation, self.runs = 0, 0
        self.stem = f"gaugeloom_store_{uuid.uuid4().hex}"

    @property
    def name(self) -> str:
        return f"{self.stem}_{self.generation}"

    @property
    def files(self) -> str:
        return f"{self.path}/{self.generation}"

    def _write(self, rows: DataFrame) -> None:
        writer = rows.select(*self.keys, self.delivery, "_run").write.format("parquet").partitionBy("_run").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", self.files).mode("append").saveAsTable(self.name)

    def upsert(self, batch: DataFrame, run: Column | None = None, runs: int = 1) -> "MessageStore":
        """Add a batch as one sorted run per bucket. Rows with a null in any identifier column are left out.

        run: a number in [0, runs) that tells which of several runs a row belongs to: the runs of
        many batches are then made in one pass, each as if it had been upserted alone.
        """
        which = F.lit(0) if run is None else run
        known = batch.select(*self.keys, self.delivery, which.alias("_run"))
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        # One row per identifier leaves the aggregation, with its smallest delivery in each run; it lies in its bucket's task.
        firsts = F.array(*[F.struct(F.lit(self.runs + r).alias("_run"), F.min(F.when(F.col("_run") == r, F.col(self.delivery))).alias(self.delivery)) for r in range(runs)])
        rows = known.groupBy(*self.keys).agg(firsts.alias("_firsts")).select(*self.keys, F.explode(F.filter("_firsts", lambda x: x[self.delivery].isNotNull())).alias("_x"))
        self._write(rows.select(*self.keys, "_x.*"))
        self.runs += runs
        return self

    def compact(self) -> DataFrame:
        """One row per message: identifier columns and its smallest delivery.

        The runs of a bucket are merged in identifier order and of equal identifiers the first
        stays: one pass over each bucket, without a shuffle. The merged run is written as the
        store's new and only run, and the others are deleted.
        """
        if self.runs > 1:
            runs = self.spark.table(self.name)
            merged = runs.withColumn("_place", F.row_number().over(Window.partitionBy(*self.keys).orderBy(self.delivery))).where("_place = 1")
            old_name, old_files = self.name, self.files
            self.generation += 1
            self._write(merged.select(*self.keys, self.delivery, F.lit(0).alias("_run")))
            self.spark.sql(f"drop table {old_name}")
            delete(self.spark, old_files)
            self.runs = 1
        return self.spark.table(self.name).drop("_run")

    def close(self) -> DataFrame:
        """The compacted rows, read from their files alone; the catalogue forgets the store."""
        self.compact()
        schema = self.spark.table(self.name).schema
        self.spark.sql(f"drop table {self.name}")
        return self.spark.read.schema(schema).parquet(self.files).drop("_run")


def message_identifier(item: Column, model: Column, at: Column) -> list[Column]:
    """Item, model and instant as compared: case, outer white space and the way an instant is written do not matter."""
    return [clean_id(item).alias("_item"), clean_id(model).alias("_model"), instant_micros(at).alias("_at")]


def _named(predictions: DataFrame) -> DataFrame:
    batch = [F.col("batch_id")] if "batch_id" in predictions.columns else [F.lit("").alias("batch_id")]
    return predictions.select("delivery_id", *batch, *message_identifier(F.col("item_id"), F.col("model_id"), F.col("timestamp")))


COMPARED = "_item is not null and _model is not null and _at is not null"


def kept_deliveries(predictions: DataFrame, batches: list[DataFrame] | None = None) -> DataFrame:
    """(delivery_id) of the delivery that stands for each message, through a store of sorted runs that are merged.

    The batches of predictions (batch_id) are spread over ``RUNS`` runs by a hash; several
    frames are upserted one after another instead.
    """
    store = MessageStore(predictions.sparkSession, ["_item", "_model", "_at"], "delivery_id")
    for b in batches or [predictions]:
        store.upsert(_named(b), F.pmod(F.xxhash64("batch_id"), F.lit(RUNS)).cast("int"), RUNS)
    return store.close().select("delivery_id")


def repeated_deliveries(predictions: DataFrame, batches: list[DataFrame] | None = None) -> DataFrame:
    """(delivery_id) of every delivery that repeats a message with a smaller delivery_id.

    Nulls: rows with a null item, model or timestamp, or a timestamp that is no instant, are
    never compared and never reported; a null batch_id is a batch like any other. Empty texts
    are identifiers like any other. Ties cannot occur, as delivery_id is unique; fully repeated
    rows (same delivery_id) are one delivery. An empty table gives an empty result. Further
    columns are ignored.
    batches: the deliveries as they arrived, if they come as several frames.
    """
    kept = kept_deliveries(predictions, batches)
    whole = None
    for b in batches or [predictions]:
        whole = _named(b) if whole is None else whole.unionByName(_named(b))
    return whole.where(COMPARED).select("delivery_id").join(kept, "delivery_id", "left_anti").distinct()


def first_deliveries(predictions: DataFrame) -> DataFrame:
    """The predictions without repeated deliveries, all columns as delivered. Rows that cannot be compared stay."""
    kept = kept_deliveries(predictions).withColumn("_kept", F.lit(True))
    item, model, at = message_identifier(F.col("item_id"), F.col("model_id"), F.col("timestamp"))
    compared = item.isNotNull() & model.isNotNull() & at.isNotNull()
    return predictions.join(kept, "delivery_id", "left").where(F.col("_kept") | ~compared).drop("_kept")
