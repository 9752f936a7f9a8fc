"""Small relational steps: lookups that fail loudly, checks of a whole table, restrictions, rows gathered per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.functions import labels as L
from gaugeloom.operators.statistics import hash_order


def names_variant(variant: Column, *words: str) -> Column:
    """The variant's name holds one of the words; case and outer blanks do not matter, null is false."""
    name = F.lower(F.trim(variant))
    hit = F.lit(False)
    for w in words:
        hit = hit | name.contains(w)
    return F.coalesce(hit, F.lit(False))


def is_attribution(variant: Column) -> Column:
    return names_variant(variant, "attribution")


def is_compatibility(variant: Column) -> Column:
    return names_variant(variant, "compatibility", "diversity", "category")


def gold_count(declared: Column, gold: Column) -> Column:
    """The declared number of right labels, else how many there are (0 for a null array)."""
    return F.coalesce(declared, F.size(F.coalesce(gold, L.empty())))


def label_space(own: Column, everyone: list[str]) -> Column:
    """The labels an item may be answered with: its own, else those of all items."""
    listed = F.array(*[F.lit(x) for x in everyone]).cast("array<string>")
    return F.when(F.size(F.coalesce(own, L.empty())) > 0, own).otherwise(listed)


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; none is an error. The filter reaches the scan."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise KeyError(f"no {key} {value!r}")
    return found


def probe(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key, possibly none."""
    return df.where(F.col(key) == F.lit(value))


def only_value(df: DataFrame, column: str):
    """The one value a column has in all rows; several, or none, are an error."""
    r = df.agg(F.count_distinct(column).alias("n"), F.min(column).alias("v"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if r["n"] != 1 or r["nulls"]:
        raise ValueError(f"{column} has {r['n']} values and {r['nulls']} nulls, not one")
    return r["v"]


def unsupported(asked: list[str], supported: list[str]) -> None:
    """Names that are not supported are an error that lists them."""
    odd = [a for a in dict.fromkeys(asked) if a not in supported]
    if odd:
        raise ValueError(f"not supported: {', '.join(odd)}")


def restricted(df: DataFrame, condition: Column, key: str, n: int, seed: int | None = None) -> DataFrame:
    """At most n rows that meet a condition: the first by key, or by md5 of seed and key. The bound is what is asked for."""
    order = [F.col(key)] if seed is None else [hash_order(F.lit(str(seed)), F.col(key).cast("string")), F.col(key)]
    return df.where(condition).orderBy(*order).limit(n)


def gathered(df: DataFrame, key: str, keep: list[str], task: str, order: list[str]) -> DataFrame:
    """(key, keep..., tasks): the first row's columns of each key and its distinct tasks, sorted; rows are combined map-side."""
    first = F.min_by(F.struct(*keep), F.struct(*order)) if keep else None
    out = df.groupBy(key).agg(*([first.alias("_f")] if keep else []), F.array_sort(F.collect_set(task)).alias("tasks"))
    return out.select(key, *([f"_f.{c}" for c in keep]), "tasks")


def prediction_record(item: Column, variant: Column, model: str, seed: int | None, pred: Column, constrained: Column) -> dict[str, Column]:
    """Columns of a baseline's prediction in either answer space: option ids where options are given, else labels as parsed text."""
    none = F.lit(None).cast("array<string>")
    free = ~constrained
    return {
        "record_id": item, "item_id": item, "variant": variant, "model_name": F.lit(model), "seed": F.lit(seed).cast("int"), "answer_space_type": F.when(constrained, "constrained").otherwise("freeform"),
        "answer_count_predicted": F.size(pred), "parse_error": F.lit(0), "choices": F.when(constrained, pred).otherwise(none), "selected_option_ids": F.when(constrained, pred).otherwise(none),
        "prediction_labels": F.when(free, pred).otherwise(none), "normalized_predictions": F.when(free, pred).otherwise(none), "unresolved_tokens": F.when(free, L.empty()).otherwise(none), "parser_status": F.when(free, "ok"),
    }
