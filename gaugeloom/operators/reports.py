"""Reports from scored tables: pivots, gaps, cross tables, failure examples, merged summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeloom.functions import labels as L
from gaugeloom.runtime import bounded


def matrix(long: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """One row per ``row`` with a column per fixed value of ``col``; absent cells are null."""
    return long.groupBy(row).pivot(col, columns).agg(F.first(value))


def best_per(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each ``by``; ties go to the smallest ``tie``. An aggregation, not a window over all rows."""
    rest = [c for c in df.columns if c != by]
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(tie))).alias("_r")).select(by, "_r.*")


def ranking(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Rows (one per model) numbered from 1 by falling value, ties by ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(value), F.col(tie))))


def gap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds gap = a - b and relative_gap = gap / a (0 if a is 0)."""
    return df.withColumn("gap", F.col(a) - F.col(b)).withColumn("relative_gap", L.ratio(F.col("gap"), F.col(a)))


def conditional_rates(pairs: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """P(b | a), P(b | not a), P(not b | a), P(not b | not a) per ``by``; null where undefined."""
    both = lambda x, y: F.count_if(x & y)
    n_a, n_not = F.count_if(a), F.count_if(~a)
    return pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(both(b, a), n_a).alias("p_b_given_a"), F.try_divide(both(b, ~a), n_not).alias("p_b_given_not_a"),
        F.try_divide(both(~b, a), n_a).alias("p_not_b_given_a"), F.try_divide(both(~b, ~a), n_not).alias("p_not_b_given_not_a"),
    )


def consistency_by_correctness(df: DataFrame, by: list[str], consistent: Column, correct: Column) -> DataFrame:
    """Per ``by``: counts of the four cells consistent x correct."""
    return df.groupBy(*by).agg(
        F.count_if(consistent & correct).alias("consistent_correct"), F.count_if(consistent & ~correct).alias("consistent_wrong"),
        F.count_if(~consistent & correct).alias("inconsistent_correct"), F.count_if(~consistent & ~correct).alias("inconsistent_wrong"),
    )


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value of both sides and delta = a - b, for keys that both have."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys).withColumn("delta", F.col("a") - F.col("b"))


def first_per_class(df: DataFrame, classes: dict[str, Column], order: list[str]) -> DataFrame:
    """(failure_class, row...) the first row of each class; a row may stand for several."""
    hits = F.array_compact(F.array(*[F.when(c, name) for name, c in classes.items()]))
    rows = df.select(F.explode(hits).alias("failure_class"), "*")
    rest = [c for c in rows.columns if c != "failure_class"]
    return rows.groupBy("failure_class").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select("failure_class", "_r.*")


def upsert(keys: list[str], **parts: DataFrame) -> DataFrame:
    """Full outer merge of several tables on their keys; each keeps its own columns."""
    out = None
    for part in parts.values():
        out = part if out is None else out.join(part, keys, "full")
    return out


def baselines_first(df: DataFrame, name: str) -> DataFrame:
    """Sorted with baseline_ rows first, then by name."""
    return df.orderBy((~F.col(name).startswith("baseline_")).cast("int"), name)


def markdown(df: DataFrame, columns: list[str] | None = None, digits: int = 3, limit: int = 10_000) -> str:
    """A small result as a Markdown table; nulls are NA. More than ``limit`` rows are an error."""
    columns = columns or df.columns
    show = lambda v: "NA" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    rows += ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in bounded(df.select(*columns), limit)]
    return "\n".join(rows) + "\n"


def per_model(documents: DataFrame, reports: str = "per_model", fields: list[str] = (), inner: str | None = None) -> DataFrame:
    """(variant, model, fields...) from report documents with a map from model to its metrics; ``inner`` names a struct of the metrics to take them from."""
    rows = documents.select("variant", F.explode(reports).alias("model", "_m"))
    at = F.col(f"_m.{inner}") if inner else F.col("_m")
    return rows.select(F.coalesce("variant", F.lit("unknown_variant")).alias("variant"), "model", *[at[f].alias(f) for f in fields])


def overall(documents: DataFrame, fields: list[str]) -> DataFrame:
    """(variant, model, fields...) of metric documents with an ``overall`` struct; documents without one are left out. Fields that a document lacks are null."""
    inside = documents.schema["overall"].dataType.fieldNames()
    pick = [F.col(f"overall.{f}").alias(f) if f in inside else F.lit(None).cast("double").alias(f) for f in fields]
    return documents.where("overall is not null").select("variant", F.col("model_name").alias("model"), *pick)


def histograms(df: DataFrame, **keys: Column) -> DataFrame:
    """(statistic, key, n): counts of rows by each of several keys, in one pass with grouping sets; null keys are ``unknown``."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("key")) for name, c in keys.items()])).alias("x"))
    return rows.select("x.*").groupBy("statistic", "key").agg(F.count(F.lit(1)).alias("n"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) of every key of two sets; null keys are equal to each other."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(key).agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))


def full_report(title: str, **sections: DataFrame) -> str:
    """A whole report in Markdown: a heading and a table per section; sections of more rows than a table takes are an error."""
    return f"# {title}\n\n" + "\n".join(f"## {name.replace('_', ' ')}\n\n{markdown(df)}" for name, df in sections.items())
