"""Queries on delivered records: repeats, drifting schemas, nested records, missing references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeloom.operators import drift, flatten, messages, references
from gaugeloom.runtime import WHITESPACE, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.repeated_deliveries(table(spark, sf_dir, "predictions"))


def p1_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = messages.first_deliveries(table(spark, sf_dir, "predictions"))
    return kept.select("delivery_id", "item_id", "model_id", "timestamp", "raw_text", "batch_id", "delivered_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.file_changes(table(spark, sf_dir, "raw_records"))


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "raw_records"), "items")


def p2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "raw_records"), "predictions")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.item_children(table(spark, sf_dir, "benchmark_items"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.parent_table(table(spark, sf_dir, "benchmark_items"), "item_row")


def p5_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.child_table(table(spark, sf_dir, "benchmark_items"), "item_row", "options")


def p5_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.child_table(table(spark, sf_dir, "benchmark_items"), "item_row", "meta.target_instances")


def p5_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the answer's lists, with their values."""
    return flatten.answer_values(table(spark, sf_dir, "benchmark_items"))


def p5_target_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the boxes of an item's targets: a list within a list; target_instances_pos is pos of p5_targets."""
    return flatten.child_table(table(spark, sf_dir, "benchmark_items"), "item_row", "meta.target_instances.bbox_xyxy")


def p5_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the box that an item's person image is focused on."""
    return flatten.child_table(table(spark, sf_dir, "benchmark_items"), "item_row", "person_image.focus.bbox_xyxy")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "benchmark_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "benchmark_items"))


QUERIES = {f.__name__: f for f in (p1_found, p1_first, p2_found, p2_items, p2_predictions, p5_found, p5_items, p5_options, p5_targets, p5_answers, p5_target_boxes, p5_focus, p7_found, p7_report)}


def _id(c: str) -> str:
    return f"lower(trim({c}, '{WHITESPACE}'))"


_INSTANT = """epoch_us(try_cast(case when regexp_matches("timestamp", '([+-][0-9][0-9]:?[0-9][0-9]|[Zz])\\s*$') then "timestamp"
  else "timestamp" || 'Z' end as timestamptz))"""

_RANKED = f"""select *, case when item_id is null or model_id is null or {_INSTANT} is null then 1
  else row_number() over (partition by {_id('item_id')}, {_id('model_id')}, {_INSTANT} order by delivery_id) end as place from predictions"""

_P5 = " union all ".join(
    f"""select item_row, '{path}' as child, cast(i - 1 as integer) as pos
    from (select item_row, {path} as a, unnest(generate_series(1, len({path}))) as i from benchmark_items) where a[i] is not null"""
    for path in flatten.ITEM_CHILDREN[:4]
)

_ORPHANS = f"""with parents as (
  select {_id('item_id')} as k, case when count(*) = count(loaded_at) then min(loaded_at) end as loaded, max(deleted_at) as deleted
  from benchmark_items where item_id is not null group by 1)
select delivery_id, strftime(delivered_at, '%Y-%m') as period
from (select * from predictions where item_id is not null) p left join parents on {_id('p.item_id')} = k
where k is null or delivered_at < loaded or delivered_at >= deleted"""

ORACLE = {
    "p1_found": f"select delivery_id from ({_RANKED}) where place > 1",
    "p1_first": f'select delivery_id, item_id, model_id, "timestamp", raw_text, batch_id, delivered_at from ({_RANKED}) where place = 1',
    "p5_found": f"""{_P5} union all select item_row, 'person_image.focus' as child, 0 as pos from benchmark_items where person_image.focus is not null""",
    "p5_items": """select item_row, item_id, person_image.image_id as person_image_image_id, person_image.path as person_image_path,
      person_image.focus.mode as person_image_focus_mode, query.template_id as query_template_id, query.text as query_text,
      answer.mode as answer_mode, answer.num_correct as answer_num_correct, meta.source as meta_source, meta.subset as meta_subset,
      meta.num_options as meta_num_options, meta.has_multiple_targets as meta_has_multiple_targets, meta.seed as meta_seed,
      options_grid.enabled as options_grid_enabled, options_grid.path as options_grid_path, loaded_at, deleted_at from benchmark_items""",
    "p5_options": """select item_row, cast(i - 1 as integer) as pos, a[i].option_id as option_id, a[i]."type" as "type", a[i].path as path,
      a[i].part8 as part8, a[i].coarse_part as coarse_part
      from (select item_row, options as a, unnest(generate_series(1, len(options))) as i from benchmark_items) where a[i] is not null""",
    "p5_targets": """select item_row, cast(i - 1 as integer) as pos, a[i].instance_id as instance_id, a[i].annotation_id as annotation_id,
      a[i].coarse_part as coarse_part, a[i].part8 as part8, a[i].source_type as source_type
      from (select item_row, meta.target_instances as a, unnest(generate_series(1, len(meta.target_instances))) as i from benchmark_items) where a[i] is not null""",
    "p5_answers": " union all ".join(
        f"""select item_row, '{path}' as child, cast(i - 1 as integer) as pos, a[i] as value
        from (select item_row, {path} as a, unnest(generate_series(1, len({path}))) as i from benchmark_items) where a[i] is not null"""
        for path in flatten.ANSWER_LISTS
    ),
    "p5_target_boxes": """with t as (select item_row, cast(i - 1 as integer) as target_instances_pos, a[i].bbox_xyxy as box
      from (select item_row, meta.target_instances as a, unnest(generate_series(1, len(meta.target_instances))) as i from benchmark_items) where a[i] is not null)
      select item_row, target_instances_pos, cast(j - 1 as integer) as pos, box[j] as value from (select *, unnest(generate_series(1, len(box))) as j from t) where box[j] is not null""",
    "p5_focus": """select item_row, cast(i - 1 as integer) as pos, a[i] as value
      from (select item_row, person_image.focus.bbox_xyxy as a, unnest(generate_series(1, len(person_image.focus.bbox_xyxy))) as i from benchmark_items) where a[i] is not null""",
    "p7_found": _ORPHANS,
    "p7_report": f"select 'predictions' as table_name, period, count(*) as n_orphans from ({_ORPHANS}) group by period",
}
