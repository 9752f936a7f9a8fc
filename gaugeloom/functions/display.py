"""Column functions for names, paths and times in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestamp_slug(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def rate(per_second: Column) -> Column:
    """Items per second, or per minute where they are under one a second."""
    return F.when(per_second >= 1, F.format_string("%.2f it/s", per_second)).otherwise(F.format_string("%.2f it/min", per_second * 60))


def days_hours_minutes(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return F.format_string("%dd %dh %dm", F.floor(m / 1440), F.floor(F.pmod(m, F.lit(1440)) / 60), F.pmod(m, F.lit(60)))


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left if the pace stays; null before the first item."""
    return F.try_divide(elapsed * (total - done), F.when(done > 0, done))


def variant_of_path(path: Column) -> Column:
    """Variant an item file's name speaks of."""
    return F.when(path.contains("category"), "compatibility_category").when(path.contains("compat") | path.contains("match"), "compatibility_diversity").when(path.contains("freeform"), "attribution_freeform").otherwise("unknown")


def image_path(root: str, project: str, name: Column) -> Column:
    """root/name, relative to the project where it lies below it."""
    whole = F.concat_ws("/", F.lit(root.rstrip("/")), name)
    return F.when(whole.startswith(project.rstrip("/") + "/"), F.substring(whole, len(project.rstrip("/")) + 2, 10_000)).otherwise(whole)


def model_size(name: Column) -> Column:
    """Billions of parameters in a model name, null if it names none."""
    return F.nullif(F.regexp_extract(F.lower(name), r"(\d+(?:\.\d+)?)b(?:$|[^a-z])", 1), F.lit("")).try_cast("double")


def model_title(name: Column) -> Column:
    """Dashes and underscores as blanks, words capitalized, sizes in upper case."""
    words = F.split(F.regexp_replace(name, "[-_]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\d+(\.\d+)?[bB]$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))), " ")


def ordered_models(df: DataFrame, name: str, families: list[str]) -> DataFrame:
    """Sorted by family in the given order (others last), then size, plain before instruct before thinking, then name."""
    low = F.lower(F.col(name))
    family = F.lit(len(families))
    for i, f in reversed(list(enumerate(families))):
        family = F.when(low.startswith(f.lower()), i).otherwise(family)
    kind = F.when(low.contains("thinking"), 2).when(low.contains("instruct"), 1).otherwise(0)
    return df.orderBy(family, F.coalesce(model_size(F.col(name)), F.lit(1e9)), kind, name)


def output_name(model: Column, normalization: str, suffix: str) -> Column:
    return F.concat_ws("_", model, F.lit(f"by_{normalization}" if normalization else "counts"), F.lit(suffix))
