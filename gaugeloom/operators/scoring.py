"""Predictions scored against gold: one row per matched prediction, and all that is aggregated from it.

The scored table has (model, item, grp, gold, pred, parse_error, signature) and the set
metrics of ``labels.set_metrics``. Predictions without gold are dropped, gold without a
prediction is not counted; ``coverage`` reports both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeloom.functions import labels as L
from gaugeloom.runtime import salted_lookup

METRICS = ["exact", "partial", "precision", "recall", "f1", "iou"]


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; null key parts are equal. Combined map-side, not windowed."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def match_gold(predictions: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null key parts match each other; gold must be unique per key."""
    right = gold.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in gold.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [predictions[k].eqNullSafe(right[f"_g_{k}"]) for k in keys])
    return predictions.join(right, on).drop(*[f"_g_{k}" for k in keys])


def coverage(predictions: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(matched, without_gold, gold_without_prediction) of distinct keys; null keys count."""
    p = predictions.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.unionByName(g, allowMissingColumns=True).groupBy(*keys).agg(F.max("_p").alias("p"), F.max("_g").alias("g"))
    return both.agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("matched"),
        F.count_if(F.col("g").isNull()).alias("without_gold"),
        F.count_if(F.col("p").isNull()).alias("gold_without_prediction"),
    )


def scored(matched: DataFrame, empty_is_perfect: bool = True, failed: Column | None = None) -> DataFrame:
    """Adds the set metrics of columns gold and pred."""
    return matched.withColumns(L.set_metrics(F.col("gold"), F.col("pred"), empty_is_perfect, failed))


def with_group(df: DataFrame, group: list[str], gate: bool = True, signature: str = "signature") -> DataFrame:
    """Adds group_any_correct, group_all_correct, group_consistency and counted (the gate).

    Groups are aggregated, combined map-side, and joined back with heavy groups salted, so that
    the rows of a group with a third of all rows stay spread. Null group parts are equal.
    """
    summary = group_summary(df, group, gate, signature).select(*group, "group_any_correct", "group_all_correct", "group_consistency", "counted")
    return salted_lookup(df, summary, group, "inner", nulls_match=True)


def group_summary(df: DataFrame, group: list[str], gate: bool = True, signature: str = "signature") -> DataFrame:
    """One row per group: sizes, means, any and all correct, consistency over signatures, gate."""
    n, distinct = F.col("num_items"), F.col("_distinct")
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("num_items"),
        (F.max("exact") >= 1).alias("group_any_correct"),
        (F.min("exact") >= 1).alias("group_all_correct"),
        F.avg("exact").alias("group_mean_exact"),
        F.avg("iou").alias("group_mean_iou"),
        F.avg("partial").alias("group_mean_partial"),
        F.count_distinct(F.coalesce(F.col(signature), F.lit("__parse_error__"))).alias("_distinct"),
    )
    out = out.withColumn("group_consistency", L.consistency(distinct, n)).drop("_distinct")
    return out.withColumn("counted", F.lit(True) if not gate else F.col("group_any_correct"))


def label_counts(df: DataFrame, by: list[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(by, label, tp, fp, fn) over the labels seen, one exploded row per label of an item."""
    rows = df.select(*by, gold, pred, F.explode(F.array_union(F.col(gold), F.col(pred))).alias("label"))
    g, p = F.array_contains(gold, F.col("label")), F.array_contains(pred, F.col("label"))
    return rows.groupBy(*by, "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def per_label(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and support."""
    p, r = L.ratio(F.col("tp"), F.col("tp") + F.col("fp")), L.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumns({"f1": L.harmonic(F.col("precision"), F.col("recall")), "support": F.col("tp") + F.col("fn")})


def micro_macro(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pooled (micro) and label-averaged (macro) precision, recall and F1; zero-filled labels count in the averages."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    mp, mr = L.ratio(tp, tp + fp), L.ratio(tp, tp + fn)
    return per_label(counts).groupBy(*by).agg(
        F.coalesce(mp, F.lit(0.0)).alias("micro_precision"), F.coalesce(mr, F.lit(0.0)).alias("micro_recall"), F.coalesce(L.harmonic(mp, mr), F.lit(0.0)).alias("micro_f1"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
    )


def with_all_labels(counts: DataFrame, vocabulary: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts with a zero row for each label of a fixed vocabulary that was not seen (per ``by``)."""
    groups = counts.select(*by).distinct().join(F.broadcast(vocabulary)) if by else vocabulary  # a fixed vocabulary
    filled = groups.join(counts, [*by, "label"], "full")
    return filled.select(*by, "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def gated_summary(df: DataFrame, by: list[str], group: list[str], gate: bool) -> DataFrame:
    """Per ``by``: kept and raw rows and groups, groups the gate excludes, and metric means over kept rows.

    group must contain ``by``. Rows are reduced to one per group (map-side combined), and the
    gate is applied to these; rows are neither joined nor gathered.
    """
    if not set(by) <= set(group):
        raise ValueError("a group must lie within one of by")
    groups = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max("exact").alias("_ok"), *[F.sum(m).alias(f"_{m}") for m in METRICS], F.sum(F.col("parse_error").cast("double")).alias("_parse_error"))
    kept = (F.col("_ok") >= 1) if gate else F.lit(True)
    n = F.sum(F.when(kept, F.col("_n")))
    mean = lambda c: L.ratio(F.sum(F.when(kept, F.col(c))), n)
    return groups.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("num_samples"), F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_num_samples"),
        F.count_if(kept).alias("num_groups"), F.count(F.lit(1)).alias("raw_num_groups"), F.count_if(~kept).alias("num_groups_excluded"),
        *[mean(f"_{m}").alias(f"avg_{m}") for m in METRICS], mean("_parse_error").alias("parse_error_rate"),
    )


def gated_label_scores(df: DataFrame, group: list[str]) -> DataFrame:
    """One row: kept and raw rows and groups, exact_accuracy, set_miou, micro and macro metrics over the gate's kept groups.

    Every item gives one row per label and one row of its own (null label). These are reduced
    to one row per group and label, map-side; the gate then only looks at a group's few label
    rows. The input is read once, and a group with a third of all items is no hot spot.
    """
    label = F.explode(F.concat(F.array_union("gold", "pred"), F.array(F.lit(None).cast("string")))).alias("label")
    rows = df.select(*group, "gold", "pred", "exact", "iou", label)
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    cells = rows.groupBy(*group, "label").agg(
        F.count(F.lit(1)).alias("n"), F.max("exact").alias("ok"), F.sum("exact").alias("exact"), F.sum("iou").alias("iou"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")
    )
    cells = cells.withColumn("kept", F.max("ok").over(Window.partitionBy(*group)) >= 1)
    item, kept = F.col("label").isNull(), F.col("kept")
    n = F.sum(F.when(item & kept, F.col("n")))
    head = cells.where(item).agg(
        F.coalesce(n, F.lit(0)).alias("num_samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_num_samples"), F.count_if(kept).alias("num_groups"), F.count(F.lit(1)).alias("raw_num_groups"),
        L.ratio(F.sum(F.when(kept, F.col("exact"))), n).alias("exact_accuracy"), L.ratio(F.sum(F.when(kept, F.col("iou"))), n).alias("set_miou"),
    )
    counts = cells.where(~item & kept).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return head.join(F.broadcast(micro_macro(counts)))  # two single rows


def mean_consistency(df: DataFrame, group: list[str], value: str, correct: str = "exact", gate: bool = True, least: int = 1, skip_null: bool = True, if_none: float = 0.0) -> DataFrame:
    """(num_groups, num_groups_excluded, mean_consistency) of one value per row.

    skip_null: rows without a value do not count, else null is a value like any other. least:
    smaller groups are left out before the gate. gate: groups without a correct row are
    excluded. if_none: the mean over no groups.
    """
    rows = df.where(F.col(value).isNotNull()) if skip_null else df.withColumn(value, F.coalesce(F.col(value), F.lit("__parse_error__")))
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("d"), (F.max(correct) >= 1).alias("ok")).where(F.col("n") >= least)
    kept = F.col("ok") if gate else F.lit(True)
    return groups.agg(
        F.count_if(kept).alias("num_groups"), F.count_if(~kept).alias("num_groups_excluded"),
        F.coalesce(F.avg(F.when(kept, L.consistency(F.col("d"), F.col("n")))), F.lit(float(if_none))).alias("mean_consistency"),
    )


def confusion(df: DataFrame, target: str, pred: str, targets: list[str], preds: list[str]) -> DataFrame:
    """(target, pred, n) with a row for every cell of the fixed grid."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, p) for t in targets for p in preds], "target string, pred string")
    counts = df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["target", "pred"], "left").fillna(0, ["n"])


def normalized(cells: DataFrame) -> DataFrame:
    """Adds each cell's share of its row, its column and the whole; 0 where the sum is 0."""
    n = F.col("n")
    share = lambda *by: L.ratio(n, F.sum("n").over(Window.partitionBy(*by)))
    return cells.withColumns({"row_share": share("target"), "col_share": share("pred"), "share": share(F.lit(1))})


def single_choice_classes(df: DataFrame, classes: list[str]) -> DataFrame:
    """(label, tp, fp, fn) of every class of a single-choice task; a null prediction misses its target."""
    long = df.where(F.col("gold").isin(classes)).select(
        F.explode(F.array_distinct(F.array_compact(F.array("gold", F.when(F.col("pred").isin(classes), F.col("pred")))))).alias("label"), "gold", "pred"
    )
    hit_g, hit_p = F.col("gold") == F.col("label"), F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    counts = long.groupBy("label").agg(F.count_if(hit_g & hit_p).alias("tp"), F.count_if(~hit_g & hit_p).alias("fp"), F.count_if(hit_g & ~hit_p).alias("fn"))
    return with_all_labels(counts, df.sparkSession.createDataFrame([(c,) for c in classes], "label string"))


def single_choice_summary(df: DataFrame, classes: list[str]) -> DataFrame:
    """num_samples, accuracy, parse errors and macro metrics of a single-choice task over all its classes."""
    valid = F.coalesce(F.col("pred").isin(classes), F.lit(False))
    known = F.coalesce(F.col("gold").isin(classes), F.lit(False))
    total = df.agg(
        F.count(F.lit(1)).alias("num_samples"), F.count_if(known & valid & (F.col("gold") == F.col("pred"))).alias("correct"), F.count_if(known & ~valid).alias("parse_error_count")
    )
    macro = micro_macro(single_choice_classes(df, classes)).select("macro_precision", "macro_recall", "macro_f1")
    return total.join(F.broadcast(macro)).select(  # two single rows
        "num_samples", L.ratio(F.col("correct"), F.col("num_samples")).alias("accuracy"), "parse_error_count", L.ratio(F.col("parse_error_count"), F.col("num_samples")).alias("parse_error_rate"), "macro_precision", "macro_recall", "macro_f1"
    )


def by_gold_size(df: DataFrame) -> DataFrame:
    """(num_correct, n, exact, partial) of rows without parse error, by number of right options."""
    ok = df.where("parse_error = 0")
    return ok.groupBy(F.size("gold").alias("num_correct")).agg(F.count(F.lit(1)).alias("n"), F.avg("exact").alias("exact_accuracy"), F.avg("partial").alias("partial_accuracy"))


def by_target(df: DataFrame, targets: str, all_targets: list[str]) -> DataFrame:
    """(target, n, exact, partial) of rows without parse error, for every target part; unseen parts have 0."""
    seen = df.where("parse_error = 0").select(F.explode(F.array_distinct(F.col(targets))).alias("target"), "exact", "partial").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("exact").alias("e"), F.avg("partial").alias("p"))
    dim = df.sparkSession.createDataFrame([(t,) for t in all_targets], "target string")
    return dim.join(seen, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0.0)).alias("exact_accuracy"), F.coalesce("p", F.lit(0.0)).alias("partial_accuracy"))


def item_confusion(df: DataFrame, targets: str, chosen: str) -> DataFrame:
    """(target, pred, n): every target part of an item against every chosen part of it."""
    rows = df.where("parse_error = 0").select(F.explode(F.array_distinct(F.col(targets))).alias("target"), chosen)
    return rows.select("target", F.explode(chosen).alias("pred")).groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))


def item_average_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Per model: means over items, pooled micro metrics, item-average macro metrics, and rates of flagged answers.

    df needs tp, fp, fn and the set metrics (empty sides count 0), and booleans invalid, hallucinated, omitted.
    """
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    mp, mr = L.ratio(tp, tp + fp), L.ratio(tp, tp + fn)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg("exact").alias("exact_set_match"), F.avg("iou").alias("set_miou"),
        mp.alias("micro_precision"), mr.alias("micro_recall"), L.harmonic(mp, mr).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in ("invalid", "hallucinated", "omitted")],
    )


def count_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per ``by``: n, mean, median, p10 and p90 (exact, linear between ranks) of an integer column."""
    q = F.percentile(F.col(value), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q")).select(
        *by, "n", "mean", F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(0)).alias("p10"), F.get("_q", F.lit(2)).alias("p90")
    )


def key_correctness(df: DataFrame, key: str, strategy: str) -> DataFrame:
    """(key, correct) by all, any or majority (at least half) of the key's rows."""
    rules = {"all": F.min("exact") >= 1, "any": F.max("exact") >= 1, "majority": F.avg((F.col("exact") >= 1).cast("double")) >= 0.5}
    if strategy not in rules:
        raise ValueError(f"unknown strategy: {strategy}")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(rules[strategy].alias("correct"))
