"""References to records that do not exist, found with a Bloom filter and an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import clean_id, heavy_keys, salted_join, shuffle_partitions

WORDS = 512  # words of 64 bits in a block: 4 KB
BITS_PER_KEY = 12
PROBES = 4


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its bit places there."""
    block = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(blocks)).cast("int")
    h = F.xxhash64(key, F.lit(29))
    return block, [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(WORDS * 64 - 1)).cast("int") for i in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str, max_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of a key column as (block, words), and its number of blocks.

    Each block has 512 words of 64 bits. Its size never passes max_bytes, however many keys
    there are: beyond that only the share of false positives grows, which the exact check
    absorbs. Blocks without keys are absent.
    """
    n = keys.count()
    blocks = max(1, min(-(-n * BITS_PER_KEY // (WORDS * 64)), max_bytes // (WORDS * 8)))
    block, bits = _place(F.col(key), blocks)
    marks = keys.where(F.col(key).isNotNull()).select(block.alias("_block"), F.explode(F.array(*bits)).alias("bit"))
    words = marks.groupBy("_block", F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits")
    )
    full = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).select(
        "_block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words")
    )
    return full, blocks


def with_bloom_hit(df: DataFrame, key: str, bloom: tuple[DataFrame, int]) -> DataFrame:
    """df with _hit: false where the key is certainly not among the filter's keys (null keys: false).

    The filter is broadcast; ``bloom_filter`` bounds its size.
    """
    words, blocks = bloom
    block, bits = _place(F.col(key), blocks)
    joined = df.withColumn("_block", block).join(F.broadcast(words), "_block", "left")
    hit = F.lit(True)
    for bit in bits:
        word = F.get("words", F.floor(bit / 64).cast("int"))
        hit = hit & (F.getbit(word, (bit % 64).cast("int")) == 1)
    return joined.withColumn("_hit", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("_block", "words")


def orphan_references(references: DataFrame, items: DataFrame) -> DataFrame:
    """(delivery_id, period) of predictions whose item is not present when delivered.

    An item is present from the earliest loaded_at of its rows until its deleted_at; if rows of
    an item name several, the latest counts, and a row without one only counts when all are null.
    Identifiers are compared without case and outer white space. A null item_id refers to
    nothing and is left out; an empty text is an identifier. Rows with a null delivered_at are
    present-checked as never present and get a null period. Items with a null loaded_at were
    always there. Repeated deliveries count each; an empty item table makes every reference an
    orphan; further columns are ignored.

    Keys the Bloom filter of item keys does not hold are orphans at once. The others are
    checked by an exact join, in which heavy items are salted.
    """
    parents = items.select(clean_id(F.col("item_id")).alias("_key"), "loaded_at", "deleted_at").where("_key is not null").groupBy("_key").agg(
        F.when(F.count_if(F.col("loaded_at").isNull()) == 0, F.min("loaded_at")).alias("loaded_at"), F.max("deleted_at").alias("deleted_at")
    )
    refs = references.select("delivery_id", clean_id(F.col("item_id")).alias("_key"), "delivered_at").where("_key is not null")
    tested = with_bloom_hit(refs, "_key", bloom_filter(parents.select("_key"), "_key"))
    sure = tested.where(~F.col("_hit")).select("delivery_id", "delivered_at")
    maybe = tested.where("_hit").drop("_hit")
    spark = references.sparkSession
    heavy = heavy_keys(refs.select("_key"), "_key", max(8, shuffle_partitions(spark)))  # of all references: one column, without the probe
    checked = salted_join(maybe, parents.withColumn("_there", F.lit(True)), "_key", ["delivery_id"], "left", heavy=heavy)
    present = (
        F.col("_there").isNotNull()
        & (F.col("loaded_at").isNull() | (F.col("delivered_at") >= F.col("loaded_at")))
        & (F.col("deleted_at").isNull() | (F.col("delivered_at") < F.col("deleted_at")))
    )
    missing = checked.where(~F.coalesce(present, F.lit(False))).select("delivery_id", "delivered_at")
    return sure.unionByName(missing).select("delivery_id", F.date_format("delivered_at", "yyyy-MM").alias("period"))


def orphan_report(references: DataFrame, items: DataFrame, table: str = "predictions") -> DataFrame:
    """(table_name, period, n_orphans) per table and month."""
    return orphan_references(references, items).groupBy("period").agg(F.count(F.lit(1)).alias("n_orphans")).select(
        F.lit(table).alias("table_name"), "period", "n_orphans"
    )
