"""Queries on texts and labels, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.llm import encodings, leaks, mixing, pairs, phrases, terms
from gaugeloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "benchmark_items"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defect_report(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "benchmark_items"))


def _label_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.label_terms(*(table(spark, sf_dir, t) for t in ("annotations", "prosthesis_instances", "category_targets")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(terms.count_terms(_label_terms(spark, sf_dir)))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.count_terms(_label_terms(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.canonical_labels(table(spark, sf_dir, "freeform_outputs"), table(spark, sf_dir, "alias_entries"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.unmatched_report(table(spark, sf_dir, "freeform_outputs"), table(spark, sf_dir, "alias_entries"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "eval_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).blocks()


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares by temperature alone: natural shares raised to the exponent that gives them the targets' entropy within the repeat limits."""
    mix = mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), by_temperature=True)
    return mix.shares().withColumn("exponent", F.round(F.lit(mix.exponent), 9))


def p9_tempered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of p9_tempered: every copy with its block and place."""
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), by_temperature=True).blocks()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_counts, p6_found, p6_report, p8_found, p8_report, p9_mix, p9_shares, p9_blocks, p9_tempered, p9_tempered_blocks, p10_found, p10_restored)}

_TERMS = """with long as (
  select 'category_name' as field_name, lower(trim(category_name)) as term, cast(image_id as varchar) as record from annotations where category_name is not null
  union all select 'part8', lower(trim(part8)), cast(image_id as varchar) from prosthesis_instances where part8 is not null
  union all select 'coarse_part', lower(trim(coarse_part)), item_id from category_targets where coarse_part is not null),
totals as (select field_name, count(distinct record) as of_records from long group by 1),
counts as (select field_name, term, count(*) as occurrences, count(distinct record) as records from long group by 1, 2),
marked as (select field_name, term, occurrences, records, of_records,
  case when records < 3 then 'rare' when records > 0.3 * of_records then 'common' end as mark from counts join totals using (field_name))
"""

_WORDS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"
_LEAKS = f"""with d as (select doc_id, {_WORDS.format('"text"')} as w from documents),
h as (select eval_id, {_WORDS.format('passage')} as w from heldout_items),
dr as (select doc_id, i, array_to_string(w[i:i + 11], ' ') as run from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as i from d)),
hr as (select distinct eval_id, array_to_string(w[i:i + 11], ' ') as run from (select eval_id, w, unnest(generate_series(1, len(w) - 11)) as i from h)),
leaks as (select doc_id, eval_id, count(*) as n_runs from dr join hr using (run) group by 1, 2)
"""

ORACLE = {
    "p8_found": _LEAKS + "select doc_id, eval_id from leaks",
    "p8_report": _LEAKS + "select eval_id, count(*) as n_documents, cast(sum(n_runs) as bigint) as n_runs from leaks group by 1",
    "p4_found": _TERMS + "select field_name, term, mark from marked where mark is not null",
    "p4_counts": _TERMS + "select * from marked",
}
