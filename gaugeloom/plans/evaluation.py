"""Evaluation queries on the test tables, each beside its SQL.

Single-choice answers come from events, label sets from orders and lineitem, option sets from
predictions and benchmark_items, free text from freeform_outputs, evidence from annotations.
Averages of fractions are rounded to nine digits, as sums of doubles depend on their order.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeloom import dims
from gaugeloom.functions import keys as K
from gaugeloom.functions import labels as L
from gaugeloom.functions import text as X
from gaugeloom.operators import construction, reports, sampling, scoring, statistics
from gaugeloom.runtime import WHITESPACE, clean_id, salted_join, salted_lookup, table, written
from gaugeloom.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CHOICES = list("abcd")


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# ---- single choice: events ------------------------------------------------------------------

def single_choice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pred = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").when(F.col("event_type") == "purchase", "c").when(F.col("event_type") == "signup", "d")
    gold = F.element_at(F.array(*[F.lit(c) for c in CHOICES]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    exact = F.coalesce((pred == gold).cast("double"), F.lit(0.0))
    return e.select(
        F.col("event_id").alias("item"), F.col("user_id").alias("grp"), "ts", "value", gold.alias("gold"), pred.alias("pred"), pred.isNull().cast("int").alias("parse_error"), pred.alias("signature"),
        *[exact.alias(m) for m in scoring.METRICS],
    )


_ONE = """with one as (select event_id as item, user_id as grp, ts, value, substr('abcd', cast(user_id % 4 as int) + 1, 1) as gold,
  case event_type when 'click' then 'a' when 'view' then 'b' when 'purchase' then 'c' when 'signup' then 'd' end as pred from events),
sc as (select *, case when pred = gold then 1 else 0 end as exact, case when pred is null then 1 else 0 end as parse_error from one)
"""
_CLASSES = """, classes as (select unnest(['a','b','c','d']) as label),
cl as (select label, count(*) filter (gold = label and pred = label) as tp, count(*) filter (gold <> label and pred = label) as fp,
  count(*) filter (gold = label and (pred is null or pred <> label)) as fn from sc cross join classes group by label),
pc as (select label, tp, fp, fn, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall, tp + fn as support from cl),
pf as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from pc)
"""


@query(_ONE + _CLASSES + """select (select count(*) from sc) as num_samples, round((select avg(exact) from sc), 9) as accuracy, (select sum(parse_error) from sc)::bigint as parse_error_count,
  round((select avg(parse_error) from sc), 9) as parse_error_rate, round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1 from pf""")
def presence_metrics(spark, d):
    return rounded(scoring.single_choice_summary(single_choice(spark, d), CHOICES))


@query(_ONE + _CLASSES + "select label, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from pf")
def presence_per_class(spark, d):
    return rounded(scoring.per_label(scoring.single_choice_classes(single_choice(spark, d), CHOICES)))


@query(_ONE + """, grid as (select t.label as target, p.label as pred from (select unnest(['a','b','c','d']) as label) t cross join (select unnest(['a','b','c','d']) as label) p),
cells as (select target, grid.pred as pred, count(item) as n from grid left join sc on gold = target and sc.pred = grid.pred group by 1, 2)
select target, pred, n, round(coalesce(n / nullif(sum(n) over (partition by target), 0), 0), 9) as row_share, round(coalesce(n / nullif(sum(n) over (partition by pred), 0), 0), 9) as col_share,
  round(coalesce(n / nullif(sum(n) over (), 0), 0), 9) as share from cells""")
def presence_confusion(spark, d):
    return rounded(scoring.normalized(scoring.confusion(single_choice(spark, d).where("pred is not null"), "gold", "pred", CHOICES, CHOICES)))


@query(_ONE + """, g as (select grp, max(exact) as ok from sc group by grp), r as (select sc.*, ok from sc join g using (grp))
select count(*) filter (ok = 1) as num_samples, count(*) as raw_num_samples, count(distinct grp) filter (ok = 1) as num_groups, count(distinct grp) as raw_num_groups,
  count(distinct grp) filter (ok = 0) as num_groups_excluded, round(coalesce(avg(exact) filter (ok = 1), 0), 9) as accuracy, round(coalesce(avg(parse_error) filter (ok = 1), 0), 9) as parse_error_rate from r""")
def presence_gated(spark, d):
    out = scoring.gated_summary(single_choice(spark, d), [], ["grp"], True)
    return rounded(out.select("num_samples", "raw_num_samples", "num_groups", "raw_num_groups", "num_groups_excluded", F.col("avg_exact").alias("accuracy"), "parse_error_rate"))


def _consistency_sql(source: str, value: str, where: str = "true", least: int = 1, if_none: float = 0.0) -> str:
    return f"""{source}, g as (select grp, count(*) as n, count(distinct {value}) as dv, max(exact) as ok from sc where {where} group by grp having count(*) >= {least})
select count(*) filter (ok = 1) as num_groups, count(*) filter (ok <> 1) as num_groups_excluded,
  round(coalesce(avg(case when n = 1 then 1 else 1 - (dv - 1) / (n - 1) end) filter (ok = 1), {if_none}), 9) as mean_consistency from g"""


@query(_consistency_sql(_ONE, "pred", "pred is not null"))
def consistency_presence(spark, d):
    return rounded(scoring.mean_consistency(single_choice(spark, d), ["grp"], "pred"))


@query(_consistency_sql(_ONE, "coalesce(pred, '__parse_error__')"))
def consistency_presence_with_errors(spark, d):
    return rounded(scoring.mean_consistency(single_choice(spark, d), ["grp"], "pred", skip_null=False))


def _strategy_sql(source: str, rule: str) -> str:
    return source + f"select grp, {rule} as correct from sc group by grp"


@query(_strategy_sql(_ONE, "min(exact) = 1"))
def image_correctness_all(spark, d):
    return scoring.key_correctness(single_choice(spark, d), "grp", "all")


@query(_strategy_sql(_ONE, "max(exact) = 1"))
def image_correctness_any(spark, d):
    return scoring.key_correctness(single_choice(spark, d), "grp", "any")


@query(_strategy_sql(_ONE, "avg(exact) >= 0.5"))
def image_correctness_majority(spark, d):
    return scoring.key_correctness(single_choice(spark, d), "grp", "majority")


# ---- label sets: orders and lineitem ---------------------------------------------------------

def label_sets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("label"))
    odd = F.pmod("l_linenumber", F.lit(2)) == 1
    sets = li.groupBy("l_orderkey").agg(F.collect_set(F.when(odd, F.col("label"))).alias("gold"), F.collect_set(F.when(~odd, F.col("label"))).alias("pred"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = o.join(sets, o["o_orderkey"] == sets["l_orderkey"], "left")
    rows = joined.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("grp"), L.as_set(F.col("gold")).alias("gold"), L.as_set(F.col("pred")).alias("pred"), F.lit(0).alias("parse_error"))
    return scoring.scored(rows.withColumn("signature", F.to_json("pred")))


_SETS = """with ls as (select l_orderkey, list_sort(list_distinct(coalesce(list(l_returnflag || '_' || l_linestatus) filter (l_linenumber % 2 = 1), []))) as gold,
  list_sort(list_distinct(coalesce(list(l_returnflag || '_' || l_linestatus) filter (l_linenumber % 2 = 0), []))) as pred from lineitem group by 1),
it as (select o_orderkey as item, o_custkey as grp, coalesce(gold, []) as gold, coalesce(pred, []) as pred from orders left join ls on l_orderkey = o_orderkey),
"""


def _scored_sql(source: str = "it", name: str = "sc", empty: str = "1.0") -> str:
    """Set metrics over a table with gold and pred; ``empty`` is the value of two empty sets for precision and recall."""
    return f"""_t_{name} as (select *, len(list_intersect(gold, pred)) as tp, len(pred) - len(list_intersect(gold, pred)) as fp, len(gold) - len(list_intersect(gold, pred)) as fn from {source}),
_p_{name} as (select *, case when fp = 0 and fn = 0 then 1 else 0 end as exact, case when tp > 0 or (len(gold) = 0 and len(pred) = 0) then 1 else 0 end as partial,
  case when len(pred) > 0 then tp / len(pred) when len(gold) = 0 then {empty} else 0.0 end as precision, case when len(gold) > 0 then tp / len(gold) when len(pred) = 0 then {empty} else 0.0 end as recall,
  case when tp + fp + fn = 0 then 1.0 else tp / (tp + fp + fn) end as iou from _t_{name}),
{name} as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from _p_{name})
"""


_SETS_SCORED = _SETS + _scored_sql()
_LABELS = """, lab as (select *, unnest(list_distinct(list_concat(gold, pred))) as label from sc),
lc as (select label, count(*) filter (list_contains(gold, label) and list_contains(pred, label)) as tp, count(*) filter (not list_contains(gold, label)) as fp, count(*) filter (not list_contains(pred, label)) as fn from lab group by label),
lp as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall, tp + fn as support from lc),
lf as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from lp)
"""
_MICRO = """, mi as (select sum(tp) / nullif(sum(tp) + sum(fp), 0) as mp, sum(tp) / nullif(sum(tp) + sum(fn), 0) as mr, avg(precision) as ap, avg(recall) as ar, avg(f1) as af from lf)
"""
_MICRO_COLUMNS = """round(coalesce(mp, 0), 9) as micro_precision, round(coalesce(mr, 0), 9) as micro_recall, round(coalesce(2 * mp * mr / nullif(mp + mr, 0), 0), 9) as micro_f1,
  round(coalesce(ap, 0), 9) as macro_precision, round(coalesce(ar, 0), 9) as macro_recall, round(coalesce(af, 0), 9) as macro_f1"""


@query(_SETS + _scored_sql("it", "all_rows") + """, ok as (select grp, max(exact) as any_ok from all_rows group by grp),
sc as (select all_rows.* from all_rows join ok using (grp) where any_ok = 1)""" + _LABELS + _MICRO + f"""
select (select count(*) from sc) as num_samples, (select count(*) from all_rows) as raw_num_samples, (select count(*) from ok where any_ok = 1) as num_groups, (select count(*) from ok) as raw_num_groups,
  round((select avg(exact) from sc), 9) as exact_accuracy, round((select avg(iou) from sc), 9) as set_miou, {_MICRO_COLUMNS} from mi""")
def attr_scoring(spark, d):
    """Flagship: label sets scored, gated by group, with micro and macro metrics over kept rows."""
    return rounded(scoring.gated_label_scores(label_sets(spark, d), ["grp"]))


@query(_SETS_SCORED + _LABELS + "select label, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from lf")
def segments_per_label(spark, d):
    return rounded(scoring.per_label(scoring.label_counts(label_sets(spark, d))))


@query(_SETS_SCORED + _LABELS + _MICRO + f"select {_MICRO_COLUMNS} from mi")
def segments_micro_macro(spark, d):
    return rounded(scoring.micro_macro(scoring.label_counts(label_sets(spark, d))))


@query(_SETS + _scored_sql() + ", " + _scored_sql("it", "sz", "0.0") + """select sc.item, sc.exact::double as exact, sc.partial::double as partial, round(sc.precision, 9) as precision, round(sc.recall, 9) as recall, round(sc.f1, 9) as f1, round(sc.iou, 9) as iou,
  sc.tp::int as tp, sc.fp::int as fp, sc.fn::int as fn, round(sz.precision, 9) as precision0, round(sz.recall, 9) as recall0, round(sz.f1, 9) as f10 from sc join sz using (item)""")
def set_metrics_item(spark, d):
    rows = label_sets(spark, d)
    zero = L.set_metrics(F.col("gold"), F.col("pred"), empty_is_perfect=False)
    return rounded(rows.select("item", *scoring.METRICS, "tp", "fp", "fn", zero["precision"].alias("precision0"), zero["recall"].alias("recall0"), zero["f1"].alias("f10")))


@query(_SETS_SCORED + """select grp, count(*) as num_items, max(exact) = 1 as group_any_correct, min(exact) = 1 as group_all_correct, round(avg(exact), 9) as group_mean_exact, round(avg(iou), 9) as group_mean_iou,
  round(avg(partial), 9) as group_mean_partial, round(case when count(*) = 1 then 1 else 1 - (count(distinct to_json(pred)) - 1) / (count(*) - 1) end, 9) as group_consistency, max(exact) = 1 as counted from sc group by grp""")
def group_summary(spark, d):
    return rounded(scoring.group_summary(label_sets(spark, d), ["grp"]))


@query(_consistency_sql(_SETS_SCORED, "to_json(pred)"))
def consistency_segments(spark, d):
    return rounded(scoring.mean_consistency(label_sets(spark, d), ["grp"], "signature"))


_CUES = {"A_F": "upper_arm_l_residual", "N_F": "forearm_r_prosthesis", "N_O": "thigh_l_prosthesis", "R_F": "calf_r_residual", "A_O": "none", "R_O": "unknown label"}


@query(_SETS + f"""m as (select map({list(_CUES)}, {list(_CUES.values())}) as m),
lab as (select item, list_filter(list_transform(pred, lambda x: m[x]), lambda x: x is not null) as l from it, m),
fit as (select item, l, list_filter(l, lambda x: regexp_matches(x, '^(upper_arm|forearm|thigh|calf)_([lr])_(residual|prosthesis)$')) as f from lab)
select item, case when len(l) = 0 or l = ['none'] then ['none_visible'] else list_sort(list_distinct(flatten(list_transform(f, lambda x: [regexp_extract(x, '^(upper_arm|forearm|thigh|calf)_', 1),
  case when regexp_extract(x, '_([lr])_', 1) = 'l' then 'left' else 'right' end, case when x like '%residual' then 'residual_limb' else 'prosthesis' end])))) end as cues from fit""")
def composite_to_cues(spark, d):
    names = F.create_map(*[F.lit(x) for kv in _CUES.items() for x in kv])
    return label_sets(spark, d).select("item", L.composite_to_cues(F.transform("pred", lambda x: F.try_element_at(names, x))).alias("cues"))


@query(_ONE + """, a as (select grp, min(exact) = 1 as ca from sc where grp is not null group by grp), """ + _SETS.replace("with ls as", "ls as") + _scored_sql("it", "s2") + """, b as (select grp, max(exact) = 1 as cb from s2 group by grp),
j as (select ca, cb from a join b using (grp)), c as (select count(*) as n, count(*) filter (ca and cb) as both_correct, count(*) filter (ca and not cb) as a_correct_b_wrong, count(*) filter (not ca and cb) as a_wrong_b_correct, count(*) filter (not ca and not cb) as both_wrong from j),
v as (select *, both_correct::double as a, a_correct_b_wrong::double as b, a_wrong_b_correct::double as c2, both_wrong::double as dd from c)
select n, both_correct, a_correct_b_wrong, a_wrong_b_correct, both_wrong, round(coalesce((a * dd - b * c2) / nullif(sqrt((a + b) * (c2 + dd) * (a + c2) * (b + dd)), 0), 0), 9) as phi,
  round(case when a > 0 then a / n * log2(a * n / ((a + b) * (a + c2))) else 0 end + case when b > 0 then b / n * log2(b * n / ((a + b) * (b + dd))) else 0 end
  + case when c2 > 0 then c2 / n * log2(c2 * n / ((c2 + dd) * (a + c2))) else 0 end + case when dd > 0 then dd / n * log2(dd * n / ((c2 + dd) * (b + dd))) else 0 end, 9) as mutual_info_bits,
  round(dd / nullif(c2 + dd, 0), 9) as p_b_wrong_given_a_wrong from v""")
def task_coupling(spark, d):
    a = scoring.key_correctness(single_choice(spark, d), "grp", "all")
    b = scoring.key_correctness(label_sets(spark, d), "grp", "any")
    return rounded(statistics.coupling(statistics.two_by_two(a, b, "grp")))


# ---- option sets: predictions and items ------------------------------------------------------

def current_items(spark: SparkSession, d: str) -> DataFrame:
    """The last loaded row of each item, keyed by its clean identifier."""
    b = table(spark, d, "benchmark_items").where("item_id is not null")
    b = b.select(clean_id(F.col("item_id")).alias("key"), "person_image", "options", "answer", "loaded_at", "item_row")
    return scoring.last_per_key(b, ["key"], ["loaded_at", "item_row"])


def option_sets(spark: SparkSession, d: str) -> DataFrame:
    items = current_items(spark, d).select(
        "key", L.clean_choices(F.col("answer.correct_option_ids")).alias("gold"), F.coalesce(F.col("person_image.path"), F.col("key")).alias("grp"),
        L.as_set(F.col("answer.target_coarse_parts")).alias("targets"), F.transform("options", lambda o: F.struct(o["option_id"].alias("id"), o["coarse_part"].alias("part"))).alias("opts"),
    )
    p = table(spark, d, "predictions").where("item_id is not null")
    p = p.select("delivery_id", clean_id(F.col("item_id")).alias("key"), clean_id(F.col("model_id")).alias("model"), L.clean_choices(F.col("choices")).alias("pred"), F.coalesce("parse_error", F.lit(0)).alias("parse_error"))
    rows = salted_join(p, items, "key", ["delivery_id"]).withColumn("variant", F.when(F.col("key").startswith("compatibility_category"), "compatibility_category").otherwise("compatibility_diversity"))
    rows = rows.withColumn("signature", F.to_json("pred"))
    return scoring.scored(rows)


def _id(c: str) -> str:
    return f"lower(trim({c}, '{WHITESPACE}'))"


_ITEMS = f"""with ranked as (select {_id('item_id')} as key, *, row_number() over (partition by {_id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null),
items as (select key, list_sort(list_distinct(list_filter(list_transform(coalesce(answer.correct_option_ids, []), lambda x: upper(trim(x))), lambda x: x <> ''))) as gold, coalesce(person_image.path, key) as grp,
  list_sort(list_distinct(list_filter(coalesce(answer.target_coarse_parts, []), lambda x: x is not null))) as targets, options from ranked where rn = 1),
it as (select delivery_id, {_id('item_id')} as key, {_id('model_id')} as model, list_sort(list_distinct(list_filter(list_transform(coalesce(choices, []), lambda x: upper(trim(x))), lambda x: x <> ''))) as pred,
  coalesce(parse_error, 0) as parse_error, gold, grp, targets, options, case when starts_with({_id('item_id')}, 'compatibility_category') then 'compatibility_category' else 'compatibility_diversity' end as variant
  from predictions join items on {_id('item_id')} = items.key),
"""
_OPTIONS = _ITEMS + _scored_sql()


@query(_OPTIONS + """select model, count(*) as num_samples, round(avg(exact), 9) as exact_accuracy, round(avg(partial), 9) as partial_accuracy, round(avg(precision), 9) as avg_precision, round(avg(recall), 9) as avg_recall,
  round(avg(f1), 9) as avg_f1, round(avg(case when len(pred) = 0 then 1 else 0 end), 9) as abstention_rate, round(avg(case when parse_error <> 0 then 1 else 0 end), 9) as parse_error_rate
  from sc where variant = 'compatibility_diversity' group by model""")
def diversity_scoring(spark, d):
    rows = option_sets(spark, d).where("variant = 'compatibility_diversity'")
    return rounded(rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg("exact").alias("exact_accuracy"), F.avg("partial").alias("partial_accuracy"), F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"),
        F.avg("f1").alias("avg_f1"), F.avg((F.size("pred") == 0).cast("double")).alias("abstention_rate"), F.avg((F.col("parse_error") != 0).cast("double")).alias("parse_error_rate"),
    ))


@query(_OPTIONS + """select model, count(*) as num_samples, round(avg(case when len(pred) = 1 and list_has_any(gold, pred) then 1 else 0 end), 9) as hit_at_1, round(avg(case when len(pred) >= 2 then 1 else 0 end), 9) as non_committal_rate,
  round(avg(len(pred)), 9) as mean_num_predictions, round(avg(exact), 9) as exact_accuracy from sc where variant = 'compatibility_category' group by model""")
def category_hit_at_1(spark, d):
    rows = option_sets(spark, d).where("variant = 'compatibility_category'")
    return rounded(rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(L.hit_at_1(F.col("gold"), F.col("pred"))).alias("hit_at_1"), F.avg((F.size("pred") >= 2).cast("double")).alias("non_committal_rate"),
        F.avg(F.size("pred").cast("double")).alias("mean_num_predictions"), F.avg("exact").alias("exact_accuracy"),
    ))


@query(_OPTIONS + "select cast(len(gold) as int) as num_correct, count(*) as n, round(avg(exact), 9) as exact_accuracy, round(avg(partial), 9) as partial_accuracy from sc where parse_error = 0 group by 1")
def by_num_correct(spark, d):
    return rounded(scoring.by_gold_size(option_sets(spark, d)))


@query(_OPTIONS + """, tg as (select unnest(targets) as target, exact, partial from sc where parse_error = 0)
select dim.target, count(exact) as n, round(coalesce(avg(exact), 0), 9) as exact_accuracy, round(coalesce(avg(partial), 0), 9) as partial_accuracy
  from (select unnest(['arm_upper', 'arm_lower', 'leg_upper', 'leg_lower']) as target) dim left join tg using (target) group by dim.target""")
def by_part(spark, d):
    return rounded(scoring.by_target(option_sets(spark, d), "targets", dims.COARSE_PARTS))


@query(_OPTIONS + """, tg as (select delivery_id, unnest(targets) as target, pred as chosen, options from sc where parse_error = 0),
ch as (select target, unnest(chosen) as c, options from tg), pt as (select target, list_filter(options, lambda o: o is not null and o.option_id = c)[1].coarse_part as pred from ch)
select target, pred, count(*) as n from pt where pred is not null group by 1, 2""")
def part_confusion(spark, d):
    rows = option_sets(spark, d)
    part = F.transform("pred", lambda c: F.get(F.filter("opts", lambda o: o["id"] == c), F.lit(0))["part"])
    return scoring.item_confusion(rows.withColumn("chosen", F.array_compact(part)), "targets", "chosen")


@query(_consistency_sql(_OPTIONS, "to_json(pred)", least=2, if_none=1.0))
def consistency_pm(spark, d):
    return rounded(scoring.mean_consistency(option_sets(spark, d), ["grp"], "signature", least=2, if_none=1.0))


@query(_OPTIONS + """, g as (select variant, model, grp, max(exact) as ok from sc group by all), r as (select sc.*, ok from sc join g on sc.variant = g.variant and sc.model is not distinct from g.model and sc.grp = g.grp)
select variant, model, count(*) filter (ok = 1) as num_samples, count(*) as raw_num_samples, count(distinct grp) filter (ok = 1) as num_groups, count(distinct grp) as raw_num_groups, count(distinct grp) filter (ok = 0) as num_groups_excluded,
  round(coalesce(avg(exact) filter (ok = 1), 0), 9) as avg_exact, round(coalesce(avg(partial) filter (ok = 1), 0), 9) as avg_partial, round(coalesce(avg(precision) filter (ok = 1), 0), 9) as avg_precision,
  round(coalesce(avg(recall) filter (ok = 1), 0), 9) as avg_recall, round(coalesce(avg(f1) filter (ok = 1), 0), 9) as avg_f1, round(coalesce(avg(iou) filter (ok = 1), 0), 9) as avg_iou,
  round(coalesce(avg(parse_error) filter (ok = 1), 0), 9) as parse_error_rate from r group by 1, 2""")
def compatibility_gated(spark, d):
    return rounded(scoring.gated_summary(option_sets(spark, d), ["variant", "model"], ["variant", "model", "grp"], True))


@query(f"""{_ITEMS} p as (select distinct {_id('item_id')} as key from predictions), g as (select distinct key from items)
select count(*) filter (p.key is not null and g.key is not null) as matched, count(*) filter (g.key is null) as without_gold, count(*) filter (p.key is null and g.key is not null) as gold_without_prediction
  from p full join g on p.key = g.key""")
def prediction_coverage(spark, d):
    p = table(spark, d, "predictions").select(clean_id(F.col("item_id")).alias("key"))
    return scoring.coverage(p, current_items(spark, d), ["key"])


@query(f"""select {_id('item_id')} as item, {_id('model_id')} as model, arg_max(delivery_id, (delivered_at, delivery_id)) as delivery_id, count(*) as n from predictions where item_id is not null and model_id is not null group by 1, 2""")
def last_prediction(spark, d):
    p = table(spark, d, "predictions").where("item_id is not null and model_id is not null")
    return p.groupBy(clean_id(F.col("item_id")).alias("item"), clean_id(F.col("model_id")).alias("model")).agg(F.max_by("delivery_id", F.struct("delivered_at", "delivery_id")).alias("delivery_id"), F.count(F.lit(1)).alias("n"))


@query(f"""select {_id('model_id')} as model, count(latency_ms) as n, sum(latency_ms)::bigint as total, round(avg(latency_ms), 9) as mean, min(latency_ms) as least, max(latency_ms) as most, round(quantile_cont(latency_ms, 0.5), 9) as median,
  round(quantile_cont(latency_ms, 0.1), 9) as p10, round(quantile_cont(latency_ms, 0.9), 9) as p90 from predictions group by 1""")
def latency_statistics(spark, d):
    p = table(spark, d, "predictions").select(clean_id(F.col("model_id")).alias("model"), "latency_ms")
    q = F.percentile("latency_ms", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = p.groupBy("model").agg(F.count("latency_ms").alias("n"), F.sum("latency_ms").alias("total"), F.avg("latency_ms").alias("mean"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"), q.alias("q"))
    return rounded(out.select("model", "n", "total", "mean", "least", "most", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(2)).alias("p90")))


# ---- text: free-form outputs and raw answers --------------------------------------------------

def free_text(spark: SparkSession, d: str) -> DataFrame:
    aliases = X.AliasTable.from_frame(table(spark, d, "alias_entries"))
    f = table(spark, d, "freeform_outputs").select("output_id", "record_id", "image_id", "model_name", "raw_text", "predicted_labels")
    parsed = aliases.parse(F.col("raw_text"))
    gold = f.groupBy("image_id").agg(F.min_by("predicted_labels", "output_id").alias("_g")).select("image_id", L.as_set(F.col("_g")).alias("gold"))
    rows = salted_lookup(f.drop("predicted_labels"), gold, ["image_id"], "inner", nulls_match=True).withColumns(parsed)
    return rows.withColumn("pred", L.as_set(F.col("predicted_labels")))


@query("""select output_id, coalesce(normalized_text, '') as normalized_text, parser_status, coalesce(flags, []) as flags from freeform_outputs""")
def freeform_parse(spark, d):
    """Parsed text, status and flags; the table itself states what they must be."""
    aliases = X.AliasTable.from_frame(table(spark, d, "alias_entries"))
    p = aliases.parse(F.col("raw_text"))
    return table(spark, d, "freeform_outputs").select("output_id", p["normalized_text"].alias("normalized_text"), p["parser_status"].alias("parser_status"), p["flags"].alias("flags"))


@query("""with al as (select canonical, normalized_alias from alias_entries union select distinct canonical, replace(canonical, '_', ' ') from alias_entries),
ff as (select output_id, trim(regexp_replace(lower(coalesce(raw_text, '')), '[\\s\\x{00a0}]+', ' ', 'g')) as t from freeform_outputs),
n as (select output_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '[^\\p{L}\\p{N}\\-/,;\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s*([,;])\\s*', '\\1', 'g'), '\\s+', ' ', 'g')) as t from ff),
items as (select output_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\\s*(?:,|;|\\bas well as\\b|\\band\\b)\\s*'), lambda x: trim(x)), lambda x: x <> '')) as item from n)
select item, count(*) as n from items group by item""")
def freeform_items(spark, d):
    """How often each item of a free-form answer occurs."""
    text = X.normal_text(F.coalesce("raw_text", F.lit("")))
    return table(spark, d, "freeform_outputs").select(F.explode(X.split_items(text)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def _free_scored(spark, d):
    rows = scoring.scored(free_text(spark, d), empty_is_perfect=False)
    return rows.withColumns({"invalid": F.col("parser_status") == "unparsable", "hallucinated": F.col("parser_status") == "hallucinated", "omitted": F.size(F.array_except("gold", "pred")) > 0})


_FREE = r"""with al as (select distinct canonical, alias from (select canonical, normalized_alias as alias from alias_entries union all select canonical, replace(canonical, '_', ' ') from alias_entries)),
pat as (select ' (' || string_agg(replace(alias, ' ', '  '), '|' order by len(string_split(alias, ' ')) desc, len(alias) desc, alias) || ') ' as rx, map(list(alias), list(canonical)) as names from al),
ff as (select output_id, record_id, image_id, model_name, trim(regexp_replace(lower(coalesce(raw_text, '')), '[\s\x{00a0}]+', ' ', 'g')) as t, predicted_labels from freeform_outputs),
n as (select * exclude t, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}\-/,;\s]', ' ', 'g'), '\s+', ' ', 'g')), '\s*([,;])\s*', '\1', 'g'), '\s+', ' ', 'g')) as t from ff),
its as (select *, list_filter(list_transform(regexp_split_to_array(t, '\s*(?:,|;|\bas well as\b|\band\b)\s*'), lambda x: trim(x)), lambda x: x <> '') as items from n),
ps as (select its.*, flatten(list_transform(items, lambda i: list_transform(regexp_extract_all(' ' || replace(i, ' ', '  ') || ' ', rx, 1), lambda p: names[replace(p, '  ', ' ')]))) as found,
  len(flatten(list_transform(items, lambda i: list_filter(regexp_split_to_array(' ' || replace(i, ' ', '  ') || ' ', rx), lambda x: trim(x) <> '')))) as rest from its, pat),
gold as (select image_id, list_sort(list_distinct(arg_min(coalesce(predicted_labels, []), output_id))) as gold from freeform_outputs group by image_id),
it as (select output_id, model_name, list_sort(list_distinct(found)) as pred, coalesce(gold, []) as gold, len(items) = 0 as invalid, len(items) > 0 and rest > 0 as hallucinated from ps join gold on ps.image_id is not distinct from gold.image_id),
"""


@query(_FREE + _scored_sql("it", "sc", "0.0") + """select model_name, count(*) as num_samples, round(avg(exact), 9) as exact_set_match, round(avg(iou), 9) as set_miou, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 9) as micro_precision,
  round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 9) as micro_recall, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 9) as micro_f1, round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall,
  round(avg(f1), 9) as macro_f1, round(avg(invalid::int), 9) as invalid_rate, round(avg(hallucinated::int), 9) as hallucinated_rate, round(avg((fn > 0)::int), 9) as omitted_rate from sc group by 1""")
def freeform_summary(spark, d):
    return rounded(scoring.item_average_summary(_free_scored(spark, d), ["model_name"]))


@query(_FREE + """q as (select model_name, len(pred) as answers from it)
select model_name, count(answers) as n, round(avg(answers), 9) as mean, round(quantile_cont(answers, 0.5), 9) as median, round(quantile_cont(answers, 0.1), 9) as p10, round(quantile_cont(answers, 0.9), 9) as p90 from q group by 1""")
def freeform_counts(spark, d):
    rows = _free_scored(spark, d)
    return rounded(scoring.count_statistics(rows.withColumn("answers", F.size("pred")), ["model_name"], "answers"))


@query("""select model_name, count(*) as num_items, round(avg(case when parser_status = 'unparsable' then 0 else 1 end), 9) as parse_success_rate, round(avg(case when parser_status = 'hallucinated' then 1 else 0 end), 9) as hallucination_rate
  from freeform_outputs group by 1""")
def parse_coverage(spark, d):
    rows = free_text(spark, d)
    return rounded(rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("num_items"), F.avg((F.col("parser_status") != "unparsable").cast("double")).alias("parse_success_rate"), F.avg((F.col("parser_status") == "hallucinated").cast("double")).alias("hallucination_rate")))


_RAW = r"""with t as (select delivery_id, regexp_replace(regexp_replace(trim(coalesce(raw_text, '')), '```json\s*', '', 'g'), '```\s*', '', 'g') as t from predictions),
o as (select *, nullif(regexp_extract(t, '(\{[^}]*\})', 1), '') as obj from t),
v as (select *, case when obj is not null and json_valid(obj) then json_extract(obj, '$.choices') end as lst,
  case when obj is not null and json_valid(obj) then upper(json_extract_string(obj, '$.choice')) end as one, regexp_extract(t, '"choices"\s*:\s*\[([^\]]*)\]', 1) as inside, regexp_matches(t, '"choices"\s*:\s*\[[^\]]*\]') as has from o),
w as (select delivery_id, case when json_type(lst) = 'ARRAY' then list_distinct(list_filter(list_transform(from_json(lst, '["VARCHAR"]'), lambda x: upper(trim(x))), lambda x: regexp_full_match(x, '[A-H]'))) end as a,
  case when regexp_full_match(one, '[A-H]') then [one] end as b, case when has and (len(regexp_extract_all(inside, '"([A-H])"', 1)) > 0 or trim(inside) = '') then list_distinct(regexp_extract_all(inside, '"([A-H])"', 1)) end as c,
  nullif(upper(regexp_extract(t, '(?i)(?:"choice"\s*:\s*"|''choice''\s*:\s*'')([A-H])["'']', 1)), '') as old,
  list_filter(['A','B','C','D','E','F','G','H'], lambda x: regexp_matches(t, '(?:^|[^A-Za-z0-9_])' || x || '(?:[^A-Za-z0-9_]|$)')) as alone from v),
r as (select delivery_id, coalesce(a, b, c, case when old is not null then [old] end, case when len(alone) > 0 then alone end) as found from w)
select delivery_id, list_sort(coalesce(found, [])) as choices, case when found is null then 1 else 0 end as parse_error from r"""


@query(_RAW)
def parse_choices(spark, d):
    p = X.with_choices(table(spark, d, "predictions").select("delivery_id", "raw_text"), "raw_text")
    return p.select("delivery_id", F.array_sort("choices_read").alias("choices"), F.col("error_read").alias("parse_error"))


@query(r"""select delivery_id, nullif(regexp_extract(lower(raw_text), '(?:^|[^a-z0-9_])([abcd])(?:[^a-z0-9_]|$)', 1), '') as by_position,
  list_filter(['a','b','c','d'], lambda x: regexp_matches(lower(coalesce(raw_text, '')), '(?:^|[^a-z0-9_])' || x || '(?:[^a-z0-9_]|$)'))[1] as by_letter from predictions""")
def parse_presence_raw(spark, d):
    p = table(spark, d, "predictions")
    return p.select("delivery_id", X.presence_by_position(F.col("raw_text")).alias("by_position"), X.presence_by_letter(F.lit(None).cast("string"), F.col("raw_text")).alias("by_letter"))


# ---- statistics ------------------------------------------------------------------------------

def model_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").where("model_id is not null").select(clean_id(F.col("model_id")).alias("model"), "latency_ms", "parse_error")
    return p.groupBy("model").agg(F.round(F.avg("latency_ms"), 4).alias("x"), F.round(F.avg("parse_error"), 3).alias("y"))


_SCORES = f"with ms as (select {_id('model_id')} as model, round(avg(latency_ms), 4) as x, round(avg(parse_error), 3) as y from predictions where model_id is not null group by 1)\n"


@query(_SCORES + "select model, x, y, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rank from ms")
def avg_rank(spark, d):
    return statistics.average_rank(model_scores(spark, d), "y").select("model", "x", "y", "rank")


@query(_SCORES + """, r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from ms),
s as (select sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, count(*) as n0, count(*) filter (a.x = b.x) as n1, count(*) filter (a.y = b.y) as n2 from ms a join ms b on a.model < b.model)
select round(coalesce(corr(x, y), 0), 9) as pearson, round(coalesce(corr(rx, ry), 0), 9) as spearman, (select round(coalesce(s / nullif(sqrt((n0 - n1)::double * (n0 - n2)), 0), 0), 9) from s) as kendall_tau_b from r""")
def correlations(spark, d):
    ms = model_scores(spark, d)
    p = ms.agg(statistics.pearson(F.col("x"), F.col("y")).alias("pearson"))
    return rounded(p.join(F.broadcast(statistics.spearman(ms, "x", "y"))).join(F.broadcast(statistics.kendall_tau_b(ms, "x", "y"))))  # single rows


@query(_SCORES + "select model, x, y, row_number() over (order by y desc, model) as rank from ms")
def model_ranking(spark, d):
    return reports.ranking(model_scores(spark, d), "y", "model")


REPLICATES = 1000  # of a bootstrap

_DRAWS = """draw as (select rep, slot, ('0x' || substr(md5((rep // 4)::varchar || ':' || slot::varchar), (8 * (rep % 4) + 1)::int, 8))::bigint % n as place from nn, (select unnest(generate_series(0, 999)) as rep) r, (select unnest(generate_series(0, (select n from nn) - 1)) as slot) s),
"""


@query(_ONE + ", nn as (select count(*) as n from sc), o as (select exact, row_number() over (order by exact) - 1 as place from sc), " + _DRAWS + """reps as (select rep, avg(exact) as m from draw join o using (place) group by rep)
select (select round(avg(exact), 9) from sc) as mean, round(stddev_samp(m), 9) as std, round(quantile_cont(m, 0.025), 9) as ci_lower, round(quantile_cont(m, 0.975), 9) as ci_upper from reps""")
def bootstrap_mean(spark, d):
    """Interval of the accuracy, rows drawn one by one."""
    rows = single_choice(spark, d).select(F.col("exact").cast("int").alias("hit"))
    reps = statistics.bootstrap_sums(rows, ["hit"], replicates=REPLICATES).select((F.col("hit") / F.col("n")).alias("m"))
    return rounded(rows.agg(F.avg("hit").alias("mean")).join(F.broadcast(statistics.interval(reps, "m"))))  # single rows


@query(_SETS_SCORED + """, nn as (select count(*) as n from sc), o as (select tp, fp, fn, row_number() over (order by tp, fp, fn) - 1 as place from sc), """ + _DRAWS + """reps as (select rep, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from draw join o using (place) group by rep),
f as (select 2 * tp / nullif(2 * tp + fp + fn, 0) as m from reps)
select (select round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) from sc) as mean, round(stddev_samp(m), 9) as std, round(quantile_cont(m, 0.025), 9) as ci_lower, round(quantile_cont(m, 0.975), 9) as ci_upper from f""")
def bootstrap_micro_f1(spark, d):
    """Interval of the pooled F1, rows drawn one by one."""
    rows = written(label_sets(spark, d).groupBy("tp", "fp", "fn").agg(F.count(F.lit(1)).alias("rows")))  # so that the sets are made once
    replicates = statistics.bootstrap_sums(rows, ["tp", "fp", "fn"], replicates=REPLICATES, weight="rows")
    return _f1_interval(rows.select(*[(F.col(c) * F.col("rows")).alias(c) for c in ("tp", "fp", "fn")]), replicates)


@query(None)
def bootstrap_micro_f1_multinomial(spark, d):
    """As bootstrap_micro_f1, drawing how often each distinct row comes: any size."""
    rows = label_sets(spark, d).select("tp", "fp", "fn")
    return _f1_interval(rows, statistics.multinomial_bootstrap_sums(rows, ["tp", "fp", "fn"], replicates=REPLICATES))


def _f1_interval(rows, replicates):
    f1 = lambda t, p, n: L.ratio(2 * t, 2 * t + p + n)
    reps = replicates.select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("m"))
    return rounded(rows.agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("mean")).join(F.broadcast(statistics.interval(reps, "m"))))


_POISSON = "case " + " ".join(f"when r < {math.floor(t * (1 << 32))} then {k}" for k, t in enumerate(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))) + " else 12 end"


@query(_ONE + f""", w as (select exact, {_POISSON} as w, rep from (select exact, rep, ('0x' || substr(md5((rep // 4)::varchar || ':' || item::varchar), (8 * (rep % 4) + 1)::int, 8))::bigint as r
  from sc, (select unnest(generate_series(0, 999)) as rep))), reps as (select rep, sum(exact * w) / sum(w) as m from w group by rep)
select round(stddev_samp(m), 9) as std, round(quantile_cont(m, 0.025), 9) as ci_lower, round(quantile_cont(m, 0.975), 9) as ci_upper from reps""")
def bootstrap_poisson(spark, d):
    """Accuracy interval by hashed Poisson weights: one pass, for tables of any size."""
    rows = single_choice(spark, d).select("item", F.col("exact").cast("int").alias("hit"))
    reps = statistics.poisson_bootstrap_sums(rows, ["hit"], "item", replicates=REPLICATES).select((F.col("hit") / F.col("n")).alias("m"))
    return rounded(statistics.interval(reps, "m"))


@query("""with runs as (select event_type as model, cast(ts as date) as run, avg(value) as v from events group by 1, 2)
select model, count(v) as n, round(avg(v), 9) as mean, round(coalesce(stddev_samp(v), 0), 9) as std from runs group by 1""")
def run_moments(spark, d):
    return rounded(statistics.moments(_runs(spark, d), "v", ["model"]))


def _runs(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.to_date("ts").alias("run")).agg(F.avg("value").alias("v"))


# ---- findings and reports --------------------------------------------------------------------

@query(_OPTIONS + """select model, round(avg(f1) filter (variant = 'compatibility_diversity'), 9) as compatibility_diversity, round(avg(case when len(pred) = 1 and list_has_any(gold, pred) then 1 else 0 end) filter (variant = 'compatibility_category'), 9) as compatibility_category
  from sc group by model""")
def finding_f1(spark, d):
    """Key metric of each variant by model."""
    rows = option_sets(spark, d)
    key = F.when(F.col("variant") == "compatibility_diversity", F.col("f1")).otherwise(L.hit_at_1(F.col("gold"), F.col("pred")))
    long = rows.groupBy("model", "variant").agg(F.round(F.avg(key), 9).alias("value"))
    return reports.matrix(long, "model", "variant", "value", ["compatibility_diversity", "compatibility_category"])


@query(_ONE + """, a as (select grp % 10 as model, avg(exact) as x from sc group by 1), """ + _SETS.replace("with ls as", "ls as") + _scored_sql("it", "s2") + """, b as (select grp % 10 as model, avg(iou) as y from s2 group by 1)
select model, round(x, 9) as presence, round(y, 9) as attribution, round(x - y, 9) as gap, round(coalesce((x - y) / nullif(x, 0), 0), 9) as relative_gap from a join b using (model)""")
def finding_f2(spark, d):
    """Gap between two tasks by model (here: ten classes of groups)."""
    model = F.pmod("grp", F.lit(10)).alias("model")
    a = single_choice(spark, d).groupBy(model).agg(F.avg("exact").alias("presence"))
    b = label_sets(spark, d).groupBy(model).agg(F.avg("iou").alias("attribution"))
    return rounded(reports.gap(a.join(b, "model"), "presence", "attribution"))


@query(_ONE + """, a as (select grp, max(exact) = 1 as ca from sc group by grp), """ + _SETS.replace("with ls as", "ls as") + _scored_sql("it", "s2") + """, b as (select grp, max(exact) = 1 as cb from s2 group by grp), j as (select grp % 10 as model, ca, cb from a join b using (grp))
select model, count(*) as n, round(count(*) filter (cb and ca) / nullif(count(*) filter (ca), 0), 9) as p_b_given_a, round(count(*) filter (cb and not ca) / nullif(count(*) filter (not ca), 0), 9) as p_b_given_not_a,
  round(count(*) filter (not cb and ca) / nullif(count(*) filter (ca), 0), 9) as p_not_b_given_a, round(count(*) filter (not cb and not ca) / nullif(count(*) filter (not ca), 0), 9) as p_not_b_given_not_a from j group by model""")
def finding_f3(spark, d):
    """Conditional rates between two tasks' groups."""
    a = scoring.key_correctness(single_choice(spark, d), "grp", "any").withColumnRenamed("correct", "ca")
    b = scoring.key_correctness(label_sets(spark, d), "grp", "any").withColumnRenamed("correct", "cb")
    pairs = a.join(b, "grp").withColumn("model", F.pmod("grp", F.lit(10)))
    return rounded(reports.conditional_rates(pairs, "model", F.col("ca"), F.col("cb")))


@query(_OPTIONS + "select variant, model, round(avg(partial), 9) as partial, round(avg(exact), 9) as exact, round(avg(partial) - avg(exact), 9) as gap, round(coalesce((avg(partial) - avg(exact)) / nullif(avg(partial), 0), 0), 9) as relative_gap from sc group by 1, 2")
def finding_f4(spark, d):
    """Gap between partial and exact matches."""
    means = option_sets(spark, d).groupBy("variant", "model").agg(F.avg("partial").alias("partial"), F.avg("exact").alias("exact"))
    return rounded(reports.gap(means, "partial", "exact"))


@query(_OPTIONS + """, g as (select variant, model, grp, count(distinct to_json(pred)) = 1 as same, max(exact) = 1 as ok from sc group by all)
select variant, model, count(*) filter (same and ok) as consistent_correct, count(*) filter (same and not ok) as consistent_wrong, count(*) filter (not same and ok) as inconsistent_correct, count(*) filter (not same and not ok) as inconsistent_wrong from g group by 1, 2""")
def finding_f5(spark, d):
    """Consistency against correctness of groups."""
    groups = scoring.group_summary(option_sets(spark, d), ["variant", "model", "grp"], gate=False)
    return reports.consistency_by_correctness(groups, ["variant", "model"], F.col("group_consistency") >= 1, F.col("group_any_correct"))


@query(_OPTIONS + """, m as (select variant, model, round(avg(f1), 9) as value from sc where model is not null group by 1, 2)
select variant, arg_min(model, (-value, model)) as model, max(value) as value from m group by variant""")
def best_model(spark, d):
    m = option_sets(spark, d).where("model is not null").groupBy("variant", "model").agg(F.round(F.avg("f1"), 9).alias("value"))
    return reports.best_per(m, "variant", "value", "model")


@query(_OPTIONS + """, k as (select model, key, round(avg(f1), 9) as v from sc where model is not null group by 1, 2), a as (select * from k where not ends_with(model, '-instruct')), b as (select replace(model, '-instruct', '') as model, key, v from k where ends_with(model, '-instruct'))
select model, key, a.v as a, b.v as b, round(a.v - b.v, 9) as delta from a join b using (model, key)""")
def paired_delta(spark, d):
    """Item-wise difference between a model and its instruct sibling."""
    k = option_sets(spark, d).where("model is not null").groupBy("model", "key").agg(F.round(F.avg("f1"), 9).alias("f1"))
    tuned = F.col("model").endswith("-instruct")
    return rounded(reports.paired_delta(k.where(~tuned), k.where(tuned).withColumn("model", F.regexp_replace("model", "-instruct$", "")), ["model", "key"], "f1"))


@query(None)
def bootstrap_paired(spark, d):
    """Interval by model of the item-wise differences of paired_delta, items drawn with replacement."""
    return paired_interval(paired_delta(spark, d))


def paired_interval(deltas: DataFrame) -> DataFrame:
    """(model, n, mean, std, ci_lower, ci_upper) of (model, delta)."""
    reps = statistics.multinomial_bootstrap_sums(deltas.select("model", "delta"), ["delta"], ["model"], replicates=REPLICATES).select("model", (F.col("delta") / F.col("n")).alias("m"))
    means = deltas.groupBy("model").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"))
    return rounded(means.join(statistics.interval(reps, "m", ["model"]), "model"))


@query(_OPTIONS + """, f as (select delivery_id, unnest(list_filter([case when parse_error <> 0 then 'parse_error' end, case when fp > 0 then 'extra' end, case when fn > 0 then 'missing' end, case when tp > 0 and exact = 0 then 'partly' end], lambda x: x is not null)) as failure_class from sc)
select failure_class, min(delivery_id) as delivery_id from f group by 1""")
def failure_examples(spark, d):
    classes = {"parse_error": F.col("parse_error") != 0, "extra": F.col("fp") > 0, "missing": F.col("fn") > 0, "partly": (F.col("tp") > 0) & (F.col("exact") == 0)}
    rows = option_sets(spark, d).select("delivery_id", "parse_error", "fp", "fn", "tp", "exact")
    return reports.first_per_class(rows, classes, ["delivery_id"]).select("failure_class", "delivery_id")


@query(_OPTIONS + """, a as (select model, count(*) as n, round(avg(exact), 9) as exact_accuracy from sc where model is not null group by 1), b as (select lower(trim(model_name)) as model, round(avg(case when parser_status <> 'unparsable' then 1 else 0 end), 9) as parse_success_rate from freeform_outputs where model_name is not null group by 1)
select model, n, exact_accuracy, parse_success_rate from a full join b using (model)""")
def control_summary(spark, d):
    """Metrics and parse coverage merged by model."""
    a = option_sets(spark, d).where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exact"), 9).alias("exact_accuracy"))
    b = table(spark, d, "freeform_outputs").where("model_name is not null").groupBy(F.lower(F.trim("model_name")).alias("model")).agg(F.round(F.avg((F.col("parser_status") != "unparsable").cast("double")), 9).alias("parse_success_rate"))
    return reports.upsert(["model"], metrics=a, coverage=b)


# ---- sampling, baselines ---------------------------------------------------------------------

_SPACE = ["A_F", "N_F", "N_O", "R_F", "A_O", "R_O"]
_SPACE_SQL = f"sp as (select {_SPACE} as space),\n"
_RANKS = """lf as (select label, count(*) as n from (select unnest(gold) as label from it) group by 1), rk as (select list(label order by n desc, label) as ranked from lf),
sz as (select len(gold) as k, count(*) as n from it group by 1), md as (select k from sz order by n desc, k limit 1),
"""
_TAKE = "list_sort(list_transform(list_sort(list_transform(space, lambda x: [md5('0:' || item::varchar || ':' || x), x]))[1:{k}], lambda p: p[2]))"


def _baseline_sql(pred: str) -> str:
    return _SETS + _SPACE_SQL + _RANKS + f"bl as (select item, grp, gold, {pred} as pred from it, sp, rk, md),\n" + _scored_sql("bl") + """
select count(*) as num_samples, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, round(avg(exact), 9) as exact, round(avg(iou), 9) as iou from sc"""


def _baseline(spark, d, name):
    rows = label_sets(spark, d).select("item", "grp", "gold").withColumn("space", F.array(*[F.lit(x) for x in _SPACE]))
    out = scoring.scored(sampling.baseline_predictions(rows, "item", "gold", "space", name))
    return rounded(out.agg(F.count(F.lit(1)).alias("num_samples"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("exact").alias("exact"), F.avg("iou").alias("iou")))


@query(_baseline_sql("list_sort(list_filter(ranked, lambda x: list_contains(space, x))[1:k])"))
def baseline_label_freq(spark, d):
    return _baseline(spark, d, "label_freq_prior")


@query(_baseline_sql("list_sort(ranked[1:2])"))
def baseline_topk(spark, d):
    return _baseline(spark, d, "top_k_frequent")


@query(_baseline_sql("[]::varchar[]"))
def baseline_always_none(spark, d):
    return _baseline(spark, d, "always_none")


@query(_baseline_sql(_TAKE.format(k="k")))
def baseline_count_prior(spark, d):
    return _baseline(spark, d, "answer_count_prior")


@query(_baseline_sql(_TAKE.format(k="(('0x' || substr(md5('0:' || item::varchar || ':size'), 1, 8))::bigint % 7)")))
def baseline_random(spark, d):
    return _baseline(spark, d, "random")


def _pool(spark, d):
    coarse = F.element_at(F.array(*[F.lit(c) for c in dims.COARSE_PARTS]), (F.pmod("p_size", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("option_id"), coarse.alias("coarse"), F.pmod("p_partkey", F.lit(100)).alias("option_source"))


def _targets(spark, d):
    coarse = F.element_at(F.array(*[F.lit(c) for c in dims.COARSE_PARTS]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("item"), coarse.alias("coarse"), F.pmod("c_custkey", F.lit(100)).alias("source"))


def _drawn_sql(kinds: list[tuple[str, str, str, int, int]]) -> str:
    """Options drawn by the rules of ``sampling.draw_options``, every item beside the whole pool.

    kinds: (coarse part of the item, kind, part of the option, its place among the kind's parts, number drawn).
    """
    draw = lambda j: f"('0x' || substr(md5(item::varchar || ':' || kind || ':' || ({j})::varchar), 1, 15))::bigint % ({j} + 1)"
    return f"""with pool as (select p_partkey as option_id, {dims.COARSE_PARTS}[p_size % 4 + 1] as option_coarse, p_partkey % 100 as option_source from part),
tg as (select c_custkey as item, {dims.COARSE_PARTS}[c_custkey % 4 + 1] as coarse, c_custkey % 100 as source from customer),
kinds(coarse, kind, option_coarse, part_no, k) as (values {', '.join(map(str, kinds))}),
listed as (select *, row_number() over (partition by option_coarse order by substr(md5(option_source::varchar), 1, 2), option_source, md5(option_id::varchar), option_id) as place from pool),
met as (select item, kind, k, option_id, option_coarse, tg.coarse, row_number() over (partition by item, kind order by part_no, place) - 1 as number, count(*) over (partition by item, kind) as n
  from tg join kinds using (coarse) join listed using (option_coarse) where option_source <> source),
asked as (select item, kind, min(n) as n, min(least(k, n)) as m from met group by 1, 2),
d1 as (select *, case when m >= 1 then {draw('n - m')} end as a from asked),
d2 as (select *, case when m >= 2 then case when {draw('n - m + 1')} = a then n - m + 1 else {draw('n - m + 1')} end end as b from d1),
d3 as (select *, case when m >= 3 then case when {draw('n - m + 2')} in (a, b) then n - m + 2 else {draw('n - m + 2')} end end as c from d2),
q as (select met.* from met join d3 using (item, kind) where number = a or number = b or number = c),
l as (select item, option_id, option_coarse, coarse, kind, chr((row_number() over (partition by item order by md5(item::varchar || ':' || option_id::varchar), option_id) + 64)::int) as letter from q)
"""


_QUOTAS = [("positive", "same", 2), ("hard", "hard", 3), ("cross", "cross", 3)]
_RELATED = {"same": lambda c: [c], "hard": dims.hard_negatives, "cross": dims.cross_limb}
_OPTION_DRAWS = _drawn_sql([(c, kind, p, i, k) for c in dims.COARSE_PARTS for kind, relation, k in _QUOTAS for i, p in enumerate(_RELATED[relation](c))])
_PART_DRAWS = _drawn_sql([(c, p, p, 0, 1) for c in dims.COARSE_PARTS for p in dims.COARSE_PARTS])


@query(_OPTION_DRAWS + "select item, option_id, option_coarse, kind, letter from l")
def option_sampling(spark, d):
    return sampling.draw_options(_targets(spark, d), _pool(spark, d), _QUOTAS, "item", "source")


@query(_PART_DRAWS + "select item, option_id, option_coarse, letter from l")
def category_items(spark, d):
    return sampling.draw_one_per_part(_targets(spark, d), _pool(spark, d), "item", "source")


SHUFFLES = 3  # other orders asked of each item


def _shuffle_items(spark, d):
    """Option ids of every current item without null entries, and how many other orders they have."""
    items = current_items(spark, d).select(F.col("key").alias("item"), F.coalesce(F.transform(F.array_compact("options"), lambda o: o["option_id"]), F.array().cast("array<string>")).alias("opts"))
    return items.withColumn("possible", sampling.other_orders(F.size("opts")))


_SHUFFLED = f"""with recursive ranked as (select {_id('item_id')} as key, *, row_number() over (partition by {_id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null),
io as (select key as item, list_transform(list_filter(coalesce(options, []), lambda o: o is not null), lambda o: o.option_id) as opts from ranked where rn = 1),
possible as (select item, opts, len(opts) as n, case when len(opts) <= 1 then 0 else least(factorial(least(len(opts), 8)::int), factorial(8))::bigint - 1 + case when len(opts) >= 8 then 1 else 0 end end as possible from io),
"""
_NUMBER = "('0x' || substr(md5(item || ':shuffle:' || ({j})::varchar), 1, 15))::bigint % ({j} + 1)"


@query(_SHUFFLED + f"""asked as (select *, factorial(n::int)::bigint - 1 as big from possible where possible >= 3),
d1 as (select *, {_NUMBER.format(j='big - 3')} as a from asked), d2 as (select *, case when {_NUMBER.format(j='big - 2')} = a then big - 2 else {_NUMBER.format(j='big - 2')} end as b from d1),
d3 as (select *, case when {_NUMBER.format(j='big - 1')} in (a, b) then big - 1 else {_NUMBER.format(j='big - 1')} end as c from d2),
r as (select item, permutation_id, [a, b, c][permutation_id + 1] + 1 as rest, opts as remaining, []::varchar[] as options from d3, (select unnest([0, 1, 2]) as permutation_id)
  union all select item, permutation_id, rest % factorial((len(remaining) - 1)::int)::bigint, list_concat(remaining[1:rest // factorial((len(remaining) - 1)::int)::bigint], remaining[rest // factorial((len(remaining) - 1)::int)::bigint + 2:]),
  list_append(options, remaining[rest // factorial((len(remaining) - 1)::int)::bigint + 1]) from r where len(remaining) > 0)
select item, permutation_id::int as permutation_id, item || '::shuffle' || permutation_id as record_id, options from r where len(remaining) = 0""")
def option_shuffle(spark, d):
    """Three other orders of the options of every current item that has as many; option_shuffle_short names the others."""
    return sampling.permuted_copies(_shuffle_items(spark, d).where(F.col("possible") >= SHUFFLES), "item", "opts", SHUFFLES)


@query(_SHUFFLED + """z as (select 1) select item, len(opts)::int as num_options, possible::int as possible_orders, 3 as asked from possible where possible < 3""")
def option_shuffle_short(spark, d):
    """Current items whose options have fewer other orders than option_shuffle asks for."""
    short = _shuffle_items(spark, d).where(F.col("possible") < SHUFFLES)
    return short.select("item", F.size("opts").alias("num_options"), F.col("possible").alias("possible_orders"), F.lit(SHUFFLES).alias("asked"))


@query(_OPTIONS + """, x as (select model, key, delivery_id, pred, exact, f1 from sc where model is not null), i as (select model, key, stddev_pop(exact) as es, stddev_pop(f1) as fs, count(*) as n from x group by 1, 2),
ja as (select a.model, a.key, avg(case when len(list_concat(a.pred, b.pred)) = 0 then 1 else len(list_intersect(a.pred, b.pred)) / len(list_distinct(list_concat(a.pred, b.pred))) end) as j from x a join x b on a.model = b.model and a.key = b.key and a.delivery_id < b.delivery_id group by 1, 2)
select model, count(*) as num_items, round(avg(coalesce(j, 1)), 9) as selected_set_jaccard_mean, round(avg(es), 9) as exact_std_mean, round(avg(fs), 9) as f1_std_mean from i left join ja using (model, key) group by 1""")
def shuffle_sensitivity(spark, d):
    """Spread of a model's answers to repeated deliveries of an item."""
    rows = option_sets(spark, d).where("model is not null")
    return rounded(sampling.shuffle_sensitivity(rows, "model", "key", "pred"))


# ---- resume, audits, construction ------------------------------------------------------------

@query(f"select item_row from benchmark_items where {_id('item_id')} not in (select {_id('item_id')} from predictions where item_id is not null)")
def resume_anti_join(spark, d):
    """Item rows nobody has answered yet."""
    items = table(spark, d, "benchmark_items").select("item_row", clean_id(F.col("item_id")).alias("key"))
    done = table(spark, d, "predictions").where("item_id is not null").select(clean_id(F.col("item_id")).alias("key"))
    return incremental.resume(items, done, "key").select("item_row")


@query("""with ok as (select distinct user_id from events where event_type = 'purchase') select event_id, case when ok.user_id is not null then 'cached' else 'open' end as status from events left join ok using (user_id)""")
def cached_or_run(spark, d):
    e = table(spark, d, "events")
    results = e.select("user_id", (F.col("event_type") == "purchase").alias("success"))
    return incremental.cached_or_open(e.select("event_id", "user_id"), results, ["user_id"]).select("event_id", "status")


@query(f"select target_row from category_targets where item_id is null or {_id('item_id')} not in (select {_id('item_id')} from benchmark_items where deleted_at is null)")
def audit_violations(spark, d):
    """Targets of items that are not there or deleted; an audit passes if there are none."""
    t = table(spark, d, "category_targets").select("target_row", clean_id(F.col("item_id")).alias("key"))
    live = table(spark, d, "benchmark_items").where("deleted_at is null").select(clean_id(F.col("item_id")).alias("key")).distinct()
    return t.join(live, "key", "left_anti").select("target_row")


_RULE = {"subtypes": ["myo", "hook", "blade", "cover", "passive"], "device": "device"}
_NAME = "lower(trim(category_name))"
_EVIDENCE = rf"""with n as (select image_id, array_to_string(list_filter(list_transform(string_split({_NAME}, '-'), lambda x: trim(x)), lambda x: x <> ''), '-') as p from annotations),
e as (select image_id, regexp_extract('-' || p || '-', '-(left|right)-', 1) as side, case when contains('-' || p || '-', '-upper-arm-') then 'upper_arm' when regexp_matches('-' || p || '-', '-fore-?arm-') then 'forearm'
  when contains('-' || p || '-', '-thigh-') then 'thigh' when contains('-' || p || '-', '-calf-') then 'calf' end as segment,
  case when regexp_matches(p, '(^|-)residual$') then 'residual' when regexp_matches(p, '(^|-)(myo|hook|blade|cover|passive)-device$') then 'prosthesis' end as kind from n),
l as (select image_id, list_distinct(list(segment || '_' || side[1] || '_' || kind)) as seen from e where side <> '' and segment is not null and kind is not null group by 1),
ev as (select images.image_id, coalesce(seen, []) as seen from images left join l on l.image_id = images.image_id),
evidence as (select image_id, list_filter({dims.evidence_vocabulary()}, lambda x: list_contains(seen, x)) as labels, len(list_filter(seen, lambda x: ends_with(x, 'residual'))) > 0 as has_residual, len(list_filter(seen, lambda x: ends_with(x, 'prosthesis'))) > 0 as has_prosthesis from ev)
"""
_CLASS = "case when has_residual and has_prosthesis then 'residual_and_prosthesis' when has_residual then 'residual_only' when has_prosthesis then 'prosthesis_only' else 'none' end"


@query(_EVIDENCE + f"select image_id, labels, has_residual, has_prosthesis, {_CLASS} as presence_class from evidence")
def target_labels(spark, d):
    return construction.image_evidence(table(spark, d, "images"), table(spark, d, "annotations"), **_RULE)


_PROMPTS = [f"prompt {i}" for i in range(8)]


@query(_EVIDENCE + f""", c as (select image_id, labels, {_CLASS} as presence_class from evidence),
t as (select 'recognition' as task_name, image_id, 'presence_img' || image_id as group_id, case presence_class when 'residual_only' then 'a' when 'prosthesis_only' then 'b' when 'residual_and_prosthesis' then 'c' else 'd' end as target_answer, []::varchar[] as target_labels
  from c where presence_class <> 'none' union all select 'attribution', image_id, 'segments_img' || image_id, null, labels from c where len(labels) > 0),
p as (select *, list_transform(list_sort(list_transform({_PROMPTS}, lambda x: [md5(image_id::varchar || ':' || x), x]))[1:3], lambda y: y[2]) as picked from t)
select task_name, image_id, group_id, cast(i - 1 as int) as prompt_id, picked[i] as prompt, target_answer, target_labels from (select *, unnest(generate_series(1, 3)) as i from p)""")
def evidence_queries(spark, d):
    """Presence and attribution queries of every image, three sampled prompts each."""
    evidence = construction.image_evidence(table(spark, d, "images"), table(spark, d, "annotations"), **_RULE)
    a = construction.evidence_queries(evidence, "recognition", _PROMPTS, 3)
    return a.unionByName(construction.evidence_queries(evidence, "attribution", _PROMPTS, 3))


@query(f"""with k as (select image_id, annotation_id, lower(trim(part8)) as p, area from prosthesis_instances where area >= 1000 and bbox_xywh[4] > 0 and bbox_xywh[3] / bbox_xywh[4] between 0.25 and 4 and lower(trim(part8)) in {tuple(dims.PART8)}),
o as (select image_id, annotation_id, min(p) as part8 from k group by 1, 2)
select 'opt_' || lpad((row_number() over (order by image_id, annotation_id) - 1)::varchar, 6, '0') as option_id, image_id as source_image_id, annotation_id, part8, substr(part8, instr(part8, '_') + 1) as coarse_part from o""")
def option_pool(spark, d):
    return construction.option_pool(table(spark, d, "prosthesis_instances"), 1000.0).select("option_id", "source_image_id", "annotation_id", "part8", "coarse_part")


@query("""select 'images' as statistic, '' as key, count(*) as n from images union all select 'annotations', '', count(*) from annotations union all select 'prostheses', '', count(*) from prosthesis_instances
  union all select 'images_with_prostheses', '', count(distinct image_id) from prosthesis_instances union all select 'prostheses_by_part', coalesce(lower(trim(part8)), 'unknown'), count(*) from prosthesis_instances group by 2""")
def dataset_statistics(spark, d):
    return construction.dataset_statistics(table(spark, d, "images"), table(spark, d, "annotations"), table(spark, d, "prosthesis_instances"))


@query(_PART_DRAWS + """select item, list_sort(list(letter) filter (option_coarse = coarse)) as correct, case count(*) filter (option_coarse = coarse) when 0 then 'none' when 1 then 'single' else 'multiple' end as mode, cast(count(*) as int) as num_options
  from l group by item having count(*) >= 2""")
def built_items(spark, d):
    """Items with one option per part, and their answers."""
    items = construction.items_from_options(category_items(spark, d), _targets(spark, d).select("item", "coarse"), "item")
    return items.select("item", F.col("answer.correct_option_ids").alias("correct"), F.col("answer.mode").alias("mode"), F.size("options").alias("num_options"))


@query(ORACLE["presence_metrics"])
def stream_scoring(spark, d):
    """Events as a file stream, each once, written and scored."""
    schema = table(spark, d, "events").schema

    def metrics(rows):
        at = single_choice_from(rows)
        return rounded(scoring.single_choice_summary(at, CHOICES))

    return incremental.scored_by_stream(spark, f"{d}/events.parquet*", schema, ["event_id"], metrics)


def single_choice_from(rows: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in (("click", "a"), ("view", "b"), ("purchase", "c"), ("signup", "d")) for x in kv])
    gold = F.element_at(F.array(*[F.lit(c) for c in CHOICES]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return rows.select(gold.alias("gold"), F.try_element_at(names, F.col("event_type")).alias("pred"))
