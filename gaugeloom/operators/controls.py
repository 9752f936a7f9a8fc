"""Control baselines of every task variant, and which baseline runs on which variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom import dims
from gaugeloom.functions import labels as L
from gaugeloom.operators.sampling import BASELINES, MAX_LABELS, modal_size, random_subset, ranked_labels, top_labels
from gaugeloom.operators.statistics import hash_draw
from gaugeloom.runtime import bounded

FREE_TEXT = "attribution_freeform"


def is_compatible(variant: Column, baseline: Column) -> Column:
    """Fixed numbers of frequent labels are only a baseline of free text."""
    return (baseline != "top_k_frequent") | (variant == FREE_TEXT)


def baseline_runs(spark: SparkSession, variants: list[str] = dims.VARIANTS, baselines: list[str] = BASELINES) -> DataFrame:
    """(variant, baseline) of every run: two short lists, each with each, where they fit."""
    every = spark.createDataFrame([(v, b) for v in variants for b in baselines], "variant string, baseline string")
    return every.where(is_compatible(F.col("variant"), F.col("baseline")))


def _checked(variant: str, baseline: str) -> None:
    if baseline not in BASELINES or (baseline == "top_k_frequent" and variant != FREE_TEXT):
        raise ValueError(f"no baseline of {variant}: {baseline}")


def _key(seed: int, item: str) -> list[Column]:
    return [F.lit(str(seed)), F.col(item).cast("string")]


def single_choice_baseline(items: DataFrame, item: str, gold: str, baseline: str, options: list[str], seed: int = 0) -> DataFrame:
    """items with pred: a drawn option, the most frequent answer (ties: the first in the alphabet), the first option, or null for always_none."""
    _checked("presence", baseline)
    if baseline == "random":
        place = hash_draw([*_key(seed, item), F.lit("choice")], F.lit(len(options)))
        pred = F.get(F.array(*[F.lit(o) for o in options]), place.cast("int"))
    elif baseline == "label_freq_prior":
        counts = items.groupBy(F.coalesce(F.lower(F.trim(F.col(gold))), F.lit("")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), "g").limit(1).collect()
        pred = F.lit(best[0]["g"] if best else None).cast("string")
    else:
        pred = F.lit(options[0] if baseline == "answer_count_prior" else None).cast("string")
    return items.withColumn("pred", pred)


def option_set_baseline(items: DataFrame, item: str, gold: str, options: str, baseline: str, seed: int = 0) -> DataFrame:
    """items with pred: a random subset of the item's options, its most frequent right options, or its first ones, as many as are usually right (one at least), or none."""
    _checked("compatibility_diversity", baseline)
    usual = max(modal_size(items, gold), 1) if baseline in ("label_freq_prior", "answer_count_prior") else 0
    if baseline == "random":
        pred = random_subset(F.col(options), *_key(seed, item))
    elif baseline == "label_freq_prior":
        ranked = ranked_labels(items, gold)
        pred = F.slice(L.ordered_labels(F.col(options), ranked), 1, usual) if ranked else L.empty()
    elif baseline == "answer_count_prior":
        pred = F.slice(F.col(options), 1, usual)
    else:
        pred = L.empty()
    return items.withColumn("pred", pred)


def free_text_baseline(items: DataFrame, item: str, gold: str, baseline: str, seed: int = 0, k: int = 2) -> DataFrame:
    """items with pred, labels drawn from or ranked over all gold labels, and raw_output, the labels as text."""
    _checked(FREE_TEXT, baseline)
    usual = max(modal_size(items, gold), 1) if baseline in ("label_freq_prior", "answer_count_prior") else 0
    if baseline == "random":
        vocabulary = sorted(r["label"] for r in bounded(items.select(F.explode(gold).alias("label")).distinct().where("label <> ''"), MAX_LABELS))
        pred = random_subset(F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>"), *_key(seed, item), allow_empty=False) if vocabulary else L.empty()
    elif baseline == "label_freq_prior":
        pred = F.array(*[F.lit(v) for v in top_labels(items, gold, usual)]).cast("array<string>")
    elif baseline == "answer_count_prior":
        first = items.select(F.explode(gold).alias("label")).distinct().where("label <> ''").orderBy("label").limit(usual)
        pred = F.array(*[F.lit(r["label"]) for r in first.collect()]).cast("array<string>")
    elif baseline == "top_k_frequent":
        pred = F.array(*[F.lit(v) for v in top_labels(items, gold, k)]).cast("array<string>")
    else:
        pred = L.empty()
    return items.withColumn("pred", pred).withColumn("raw_output", F.array_join("pred", ", "))


def paired_audit(pairs: DataFrame, records: DataFrame, key: str, eligible: str) -> DataFrame:
    """(n_pairs, ineligible, missing, passes): pairs that may not be scored, and pairs whose record is not there. Null counts as not eligible."""
    there = records.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_there", F.lit(True))
    bad = ~F.coalesce(F.col(eligible), F.lit(False))
    counts = pairs.join(there, key, "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(bad).alias("ineligible"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return counts.withColumn("passes", (F.col("ineligible") == 0) & (F.col("missing") == 0))


def verified_pairs(pairs: DataFrame, records: DataFrame, key: str, eligible: str) -> DataFrame:
    """The pairs, if every one may be scored and has its record; else an error before anything is scored."""
    audit = paired_audit(pairs, records, key, eligible).first()
    if not audit["passes"]:
        raise ValueError(f"{audit['ineligible']} pairs may not be scored, {audit['missing']} have no record, of {audit['n_pairs']}")
    return pairs
