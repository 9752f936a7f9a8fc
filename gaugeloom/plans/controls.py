"""Queries on control baselines, item construction, task coupling and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeloom import dims, images
from gaugeloom.functions import labels as L
from gaugeloom.functions import text as X
from gaugeloom.operators import construction, controls, lookups, reports, sampling, scoring, statistics
from gaugeloom.plans import evaluation as E
from gaugeloom.runtime import clean_id, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _each(baselines: list[str], frame) -> DataFrame:
    """The rows of every baseline, with its name."""
    out = None
    for b in baselines:
        part = frame(b).select(F.lit(b).alias("baseline"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---- baselines -------------------------------------------------------------------------------

_FOUR = ["random", "label_freq_prior", "answer_count_prior", "always_none"]
_FIVE = [*_FOUR, "top_k_frequent"]


@query(f"""select v as variant, b as baseline from (select unnest({list(dims.VARIANTS)}) as v), (select unnest({_FIVE}) as b) where b <> 'top_k_frequent' or v = 'attribution_freeform'""")
def baseline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Which baseline runs on which task variant."""
    return controls.baseline_runs(spark)


@query(E._ONE + f""", top as (select gold from one group by gold order by count(*) desc, gold limit 1),
bl as (select baseline, gold, case baseline when 'random' then substr('abcd', (('0x' || substr(md5('0:' || item || ':choice'), 1, 8))::bigint % 4 + 1)::int, 1) when 'label_freq_prior' then (select gold from top) when 'answer_count_prior' then 'a' end as pred
  from one, (select unnest({_FOUR}) as baseline))
select baseline, count(*) as num_samples, count(*) filter (pred = gold) as correct, round(count(*) filter (pred = gold) / count(*), 9) as accuracy from bl group by 1""")
def baseline_presence(spark, d):
    """Accuracy of the single-choice baselines."""
    rows = E.single_choice(spark, d).select("item", "gold")
    bl = _each(_FOUR, lambda b: controls.single_choice_baseline(rows, "item", "gold", b, E.CHOICES))
    hit = F.count_if(F.col("pred") == F.col("gold"))
    return E.rounded(bl.groupBy("baseline").agg(F.count(F.lit(1)).alias("num_samples"), hit.alias("correct"), (hit / F.count(F.lit(1))).alias("accuracy")))


def _summary(scored: DataFrame) -> DataFrame:
    return E.rounded(scored.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("num_samples"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("exact").alias("exact"), F.avg("f1").alias("f1"),
    ))


_SUMMARY = "select baseline, count(*) as num_samples, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, round(avg(exact), 9) as exact, round(avg(f1), 9) as f1 from sc group by 1"
_DRAWN = "list_sort(list_transform(list_sort(list_transform({space}, lambda x: [md5('0:' || item::varchar || ':' || x), x]))[1:{k}], lambda p: p[2]))"
_RANKED = """lf as (select label, count(*) as n from (select unnest(gold) as label from it) group by 1), rk as (select coalesce(list(label order by n desc, label), []) as ranked from lf),
sz as (select len(gold) as k, count(*) as n from it group by 1), md as (select greatest(k, 1) as k from (select k from sz order by n desc, k limit 1)),
"""


@query(f"""with ranked as (select {E._id('item_id')} as key, *, row_number() over (partition by {E._id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null),
it as (select key as item, list_filter(list_transform(list_filter(coalesce(options, []), lambda o: o is not null), lambda o: o.option_id), lambda x: x is not null) as opts,
  list_sort(list_distinct(list_filter(list_transform(coalesce(answer.correct_option_ids, []), lambda x: upper(trim(x))), lambda x: x <> ''))) as gold from ranked where rn = 1),
""" + _RANKED + f"""bl as (select baseline, item, gold, case baseline when 'random' then {_DRAWN.format(space='opts', k="(('0x' || substr(md5('0:' || item || ':size'), 1, 8))::bigint % (len(opts) + 1))")}
  when 'label_freq_prior' then list_filter(ranked, lambda x: list_contains(opts, x))[1:k] when 'answer_count_prior' then opts[1:k] else [] end as pred from it, rk, md, (select unnest({_FOUR}) as baseline)),
""" + E._scored_sql("bl") + _SUMMARY)
def baseline_options(spark, d):
    """Set metrics of the option-set baselines over current items."""
    ids = F.array_compact(F.transform(F.array_compact("options"), lambda o: o["option_id"]))
    items = E.current_items(spark, d).select(F.col("key").alias("item"), F.coalesce(ids, L.empty()).alias("opts"), L.clean_choices(F.col("answer.correct_option_ids")).alias("gold"))
    return _summary(scoring.scored(_each(_FOUR, lambda b: controls.option_set_baseline(items, "item", "gold", "opts", b))))


@query("""with r as (select *, row_number() over (partition by image_id order by output_id) as rn from freeform_outputs),
it as (select coalesce(image_id::varchar, 'none') as item, list_sort(list_distinct(list_filter(coalesce(predicted_labels, []), lambda x: x is not null))) as gold from r where rn = 1),
""" + _RANKED + f"""vo as (select coalesce(list(label order by label), []) as vocabulary from lf where label <> ''),
bl as (select baseline, item, gold, case baseline when 'random' then {_DRAWN.format(space='vocabulary', k="(('0x' || substr(md5('0:' || item || ':size'), 1, 8))::bigint % len(vocabulary) + 1)")}
  when 'label_freq_prior' then ranked[1:k] when 'answer_count_prior' then vocabulary[1:k] when 'top_k_frequent' then ranked[1:2] else [] end as pred from it, rk, md, vo, (select unnest({_FIVE}) as baseline)),
""" + E._scored_sql("bl", empty="0.0") + _SUMMARY)
def baseline_free_text(spark, d):
    """Set metrics of the free-text baselines: their labels are written out as text, parsed again and scored."""
    f = table(spark, d, "freeform_outputs")
    gold = f.groupBy("image_id").agg(F.min_by("predicted_labels", "output_id").alias("g")).select(F.coalesce(F.col("image_id").cast("string"), F.lit("none")).alias("item"), L.as_set(F.col("g")).alias("gold"))
    rows = _each(_FIVE, lambda b: controls.free_text_baseline(gold, "item", "gold", b)).drop("pred")
    parsed = X.AliasTable.from_frame(table(spark, d, "alias_entries")).parse(F.col("raw_output"))
    return _summary(scoring.scored(rows.withColumn("pred", L.as_set(parsed["predicted_labels"])), empty_is_perfect=False))


# ---- items with a drawn number of right options ------------------------------------------------

_OPTIONS, _HARD, _ZERO, _LEAST, _MOST = 8, 0.5, 0.2, 1, 4
_VARIABLE_KINDS = [(c, kind, p, i) for c in dims.COARSE_PARTS for kind, parts in (("positive", [c]), ("hard", dims.hard_negatives(c)), ("cross", dims.cross_limb(c))) for i, p in enumerate(parts)]


def _hex(text: str, n: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {n}))::bigint"


def _draw_sql() -> str:
    """From asked (item, kind, n, m): m different numbers of n for each item and kind as list f, the options they stand for, and their letters."""
    chain = "d0 as (select *, []::bigint[] as f from asked)"
    for i in range(1, _OPTIONS + 1):
        j = f"(n - m + {i - 1})"
        t = f"({_hex(f"item::varchar || ':' || kind || ':' || {j}::varchar", 15)} % ({j} + 1))"
        chain += f",\nd{i} as (select * exclude (f), case when m >= {i} then list_append(f, case when list_contains(f, {t}) then {j} else {t} end) else f end as f from d{i - 1})"
    return chain + f""",
q as (select met.* from met join d{_OPTIONS} using (item, kind) where list_contains(f, number)),
l as (select *, chr((row_number() over (partition by item order by md5(item::varchar || ':' || option_id::varchar), option_id) + 64)::int) as letter from q)
"""


_LISTED = f"""with pool as (select p_partkey as option_id, {dims.COARSE_PARTS}[p_size % 4 + 1] as option_coarse, p_partkey % 100 as option_source from part),
listed as (select *, row_number() over (partition by option_coarse order by substr(md5(option_source::varchar), 1, 2), option_source, md5(option_id::varchar), option_id) as place from pool),
"""


def _variable_sql() -> str:
    return _LISTED + f"""tg as (select c_custkey as item, {dims.COARSE_PARTS}[c_custkey % 4 + 1] as coarse, c_custkey % 100 as source,
  case when {_hex("c_custkey::varchar || ':none'", 8)} % 1000000 < {int(_ZERO * 1_000_000)} then 0 else {_LEAST} + {_hex("c_custkey::varchar || ':correct'", 8)} % {_MOST - _LEAST + 1} end as num_correct from customer),
kinds(coarse, kind, option_coarse, part_no) as (values {', '.join(map(str, _VARIABLE_KINDS))}),
met as (select item, kind, num_correct, option_id, option_coarse, tg.coarse, row_number() over (partition by item, kind order by part_no, place) - 1 as number, count(*) over (partition by item, kind) as n
  from tg join kinds using (coarse) join listed using (option_coarse) where option_source <> source),
has as (select item, min(num_correct) as nc, coalesce(max(n) filter (kind = 'positive'), 0) as np, coalesce(max(n) filter (kind = 'hard'), 0) as nh, coalesce(max(n) filter (kind = 'cross'), 0) as nx from met group by 1),
r1 as (select *, least(nc, np) as p from has), r2 as (select *, least(floor(({_OPTIONS} - p) * {_HARD})::bigint, nh) as h from r1), r3 as (select *, least({_OPTIONS} - p - h, nx) as x from r2),
asked as (select item, 'positive' as kind, np as n, p as m from r3 union all select item, 'hard', nh, h from r3 union all select item, 'cross', nx, x from r3),
""" + _draw_sql()


_SEVERAL = f"list_sort(list_distinct([{dims.COARSE_PARTS}[c_custkey % 4 + 1], {dims.COARSE_PARTS}[(c_custkey // 4) % 4 + 1]]))"


def _multi_sql() -> str:
    return _LISTED + f"""tg as (select c_custkey as item, {_SEVERAL} as parts, c_custkey % 100 as source from customer),
met as (select item, kind, parts, option_id, option_coarse, row_number() over (partition by item, kind order by list_position({dims.COARSE_PARTS}, option_coarse), place) - 1 as number, count(*) over (partition by item, kind) as n
  from (select tg.item, parts, listed.*, case when list_contains(parts, option_coarse) then 'positive:' || option_coarse when list_contains(list_transform(parts, lambda p: split_part(p, '_', 1)), split_part(option_coarse, '_', 1)) then 'hard' else 'cross' end as kind
    from tg join listed on option_source <> source)),
kn as (select distinct item, kind, n from met),
has as (select item, count(*) filter (starts_with(kind, 'positive')) as p, coalesce(max(n) filter (kind = 'hard'), 0) as nh, coalesce(max(n) filter (kind = 'cross'), 0) as nx from kn group by 1),
r2 as (select *, least(floor(({_OPTIONS} - p) * {_HARD})::bigint, nh) as h from has), r3 as (select *, least({_OPTIONS} - p - h, nx) as x from r2),
asked as (select item, kind, n, case kind when 'hard' then h when 'cross' then x else 1 end as m from kn join r3 using (item)),
""" + _draw_sql()


_VARIABLE = _variable_sql()


def _variable_options(spark, d):
    targets = E._targets(spark, d).withColumn("num_correct", sampling.drawn_num_correct(F.col("item").cast("string"), _ZERO, _LEAST, _MOST))
    return sampling.draw_variable(targets, E._pool(spark, d), _OPTIONS, "num_correct", _HARD, "item", "source")


@query(_VARIABLE + "select item, option_id, option_coarse, kind, letter from l")
def variable_options(spark, d):
    """Options of items with a drawn number of right ones."""
    return _variable_options(spark, d)


@query(_VARIABLE + """select item, coalesce(list_sort(list(letter) filter (option_coarse = coarse)), []) as correct, case count(*) filter (option_coarse = coarse) when 0 then 'none' when 1 then 'single' else 'multiple' end as mode, cast(count(*) as int) as num_options
  from l group by item having count(*) >= 2""")
def variable_items(spark, d):
    """Items built from variable_options, with their answers."""
    items = construction.items_from_options(_variable_options(spark, d), E._targets(spark, d).select("item", "coarse"), "item")
    return items.select("item", F.col("answer.correct_option_ids").alias("correct"), F.col("answer.mode").alias("mode"), F.size("options").alias("num_options"))


_MULTI = _multi_sql()


def _multi_targets(spark, d):
    t = E._targets(spark, d)
    other = F.element_at(F.array(*[F.lit(c) for c in dims.COARSE_PARTS]), (F.pmod(F.floor(F.col("item") / 4), F.lit(4)) + 1).cast("int"))
    return t.select("item", "source", L.as_set(F.array("coarse", other)).alias("parts"))


@query(_MULTI + """select item, list_sort(list(letter) filter (list_contains(parts, option_coarse))) as correct, any_value(parts) as parts, cast(count(*) as int) as num_options from l group by item having count(*) >= 2""")
def multi_items(spark, d):
    """Items with one right option for each of several target parts, and their answers."""
    targets = _multi_targets(spark, d)
    options = sampling.draw_multi(targets, E._pool(spark, d), _OPTIONS, "parts", _HARD, "item", "source")
    items = construction.items_from_options(options, targets.select("item", F.explode("parts").alias("coarse")), "item")
    return items.select("item", F.col("answer.correct_option_ids").alias("correct"), F.col("answer.target_coarse_parts").alias("parts"), F.size("options").alias("num_options"))


_HISTOGRAMS = f"""with ranked as (select *, row_number() over (partition by {E._id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null),
it as (select options, answer from ranked where rn = 1)
"""


@query(_HISTOGRAMS + """select 'num_options' as statistic, coalesce(len(options)::varchar, 'unknown') as key, count(*) as n from it group by 2 union all select 'num_correct', coalesce(answer.num_correct::varchar, 'unknown'), count(*) from it group by 2
  union all select 'mode', coalesce(answer.mode, 'unknown'), count(*) from it group by 2 union all select 'num_parts', coalesce(len(answer.target_coarse_parts)::varchar, 'unknown'), count(*) from it group by 2""")
def item_histograms(spark, d):
    """Counts of current items by number of options, right options, mode and target parts."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return reports.histograms(E.current_items(spark, d), num_options=size("options"), num_correct=F.col("answer.num_correct"), mode=F.col("answer.mode"), num_parts=size("answer.target_coarse_parts"))


# ---- coupling, agreement, runs -----------------------------------------------------------------

def _three_tasks(spark, d):
    one, sets = E.single_choice(spark, d), E.label_sets(spark, d)
    parts = {"presence": (one, "majority"), "segments_any": (sets, "any"), "segments_all": (sets, "all")}
    out = None
    for name, (rows, rule) in parts.items():
        part = scoring.key_correctness(rows, "grp", rule).select(F.lit(name).alias("task"), "grp", "correct")
        out = part if out is None else out.unionByName(part)
    return out


@query(E._ONE + ", " + E._SETS.replace("with ls as", "ls as") + E._scored_sql("it", "s2") + """, long as (select 'presence' as task, grp, avg(exact) >= 0.5 as ok from sc where grp is not null group by grp
  union all select 'segments_any', grp, max(exact) = 1 from s2 where grp is not null group by grp union all select 'segments_all', grp, min(exact) = 1 from s2 where grp is not null group by grp),
c as (select a.task as task_a, b.task as task_b, count(*) as n, count(*) filter (a.ok and b.ok)::double as p, count(*) filter (a.ok and not b.ok)::double as q, count(*) filter (not a.ok and b.ok)::double as r, count(*) filter (not a.ok and not b.ok) as both_wrong from long a join long b using (grp) group by 1, 2),
v as (select *, both_wrong::double as s from c)
select task_a, task_b, n, both_wrong, round(case when task_a = task_b then 1 else s / nullif(r + s, 0) end, 9) as p_b_wrong_given_a_wrong,
  case when task_a <> task_b then round(coalesce((p * s - q * r) / nullif(sqrt((p + q) * (r + s) * (p + r) * (q + s)), 0), 0), 9) end as phi,
  case when task_a <> task_b then round(case when p > 0 then p / n * log2(p * n / ((p + q) * (p + r))) else 0 end + case when q > 0 then q / n * log2(q * n / ((p + q) * (q + s))) else 0 end
  + case when r > 0 then r / n * log2(r * n / ((r + s) * (p + r))) else 0 end + case when s > 0 then s / n * log2(s * n / ((r + s) * (q + s))) else 0 end, 9) end as mutual_info_bits from v""")
def coupling_three(spark, d):
    """How errors in three tasks go together, for every ordered pair."""
    return E.rounded(statistics.coupling_report(_three_tasks(spark, d), "grp"))


@query(E.ORACLE["correlations"].replace("select round(coalesce(corr(x, y), 0), 9) as pearson, round(coalesce(corr(rx, ry), 0), 9) as spearman", "select count(*) as n_models, case when count(*) >= 3 then round(coalesce(corr(rx, ry), 0), 9) end as spearman"))
def ranking_agreement(spark, d):
    """Agreement of two rankings of the models."""
    return E.rounded(statistics.ranking_agreement(E.model_scores(spark, d), "x", "y"))


_QUANTILES = ", ".join(f"({n}, {statistics.t_quantile(0.975, n - 1)!r})" for n in range(2, 400))
_RUNS = "with runs as (select event_type as model, cast(ts as date) as run, avg(value) as v from events group by 1, 2),\n"
_CI = "round({v} - coalesce(stddev_samp({x}) * max(t) / sqrt(count({x})), 0), 9) as ci_lower, round({v} + coalesce(stddev_samp({x}) * max(t) / sqrt(count({x})), 0), 9) as ci_upper"


@query(_RUNS + f"""q(n, t) as (values {_QUANTILES}), c as (select model, count(v) as n from runs group by 1), j as (select runs.*, t from runs join c on runs.model is not distinct from c.model left join q using (n))
select model, count(v) as n, round(avg(v), 9) as mean, round(coalesce(stddev_samp(v), 0), 9) as std, {_CI.format(v='avg(v)', x='v')} from j group by 1""")
def runs_ci(spark, d):
    """Interval of each model's mean over its runs, with Student's t (for up to 399 runs in the SQL)."""
    return E.rounded(statistics.confidence_interval(E._runs(spark, d), "v", ["model"]))


@query(f"""with runs as (select event_type as model, cast(ts as date) as run, avg(value) as v, count(*) as events from events group by 1, 2), q(n, t) as (values {_QUANTILES}),
long as (select model, 'v' as metric, v::double as x from runs where v is not null union all select model, 'events', events::double from runs),
c as (select model, metric, count(*) as n from long group by 1, 2), j as (select long.*, t from long join c on long.model is not distinct from c.model and long.metric = c.metric left join q using (n))
select model, metric, count(x) as n, round(avg(x), 9) as mean, round(coalesce(stddev_samp(x), 0), 9) as std, {_CI.format(v='avg(x)', x='x')} from j group by 1, 2""")
def runs_by_metric(spark, d):
    """As runs_ci for every number column of the runs."""
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.to_date("ts").alias("run")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("events"))
    return E.rounded(statistics.metrics_by_run(runs, ["model"]))


_PDF = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(i * abs(t) / 4000, 2) / df, -(df + 1) / 2)"


@query(_RUNS + f"""m as (select model, count(v) as n, avg(v) as mean, stddev_samp(v) as std from runs where model is not null group by 1 having count(v) >= 2),
w as (select a.model as model_a, b.model as model_b, (a.mean - b.mean) / nullif(sqrt(a.std * a.std / a.n + b.std * b.std / b.n), 0) as t,
  pow(a.std * a.std / a.n + b.std * b.std / b.n, 2) / nullif(pow(a.std * a.std / a.n, 2) / (a.n - 1) + pow(b.std * b.std / b.n, 2) / (b.n - 1), 0) as df from m a join m b on a.model < b.model),
s as (select model_a, model_b, t, df, 1 - 2 * (abs(t) / 4000 / 3) * sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * {_PDF}) as p from w, (select unnest(generate_series(0, 4000)) as i) group by 1, 2, 3, 4)
select model_a, model_b, round(t, 9) as t, round(df, 9) as df, round(p, 9) as p, p < 0.05 as significant from s""")
def welch_t(spark, d):
    """Welch's test of every pair of models; the SQL integrates the density of Student's t by Simpson's rule."""
    return E.rounded(statistics.welch_tests(E._runs(spark, d).where("model is not null"), "model", "v"))


# ---- audits and sets ---------------------------------------------------------------------------

@query(f"""with live as (select distinct {E._id('item_id')} as key from benchmark_items where deleted_at is null and item_id is not null),
p as (select {E._id('item_id')} as key, coarse_part is not null and bbox_xyxy is not null as eligible from category_targets), j as (select p.eligible, live.key as there from p left join live using (key))
select count(*) as n_pairs, count(*) filter (not eligible) as ineligible, count(*) filter (there is null) as missing, count(*) filter (not eligible) = 0 and count(*) filter (there is null) = 0 as passes from j""")
def paired_audit(spark, d):
    """Whether every target may be scored and has its item."""
    pairs = table(spark, d, "category_targets").select(clean_id(F.col("item_id")).alias("key"), (F.col("coarse_part").isNotNull() & F.col("bbox_xyxy").isNotNull()).alias("eligible"))
    live = table(spark, d, "benchmark_items").where("deleted_at is null").select(clean_id(F.col("item_id")).alias("key"))
    return controls.paired_audit(pairs, live, "key", "eligible")


@query(f"""with a as (select distinct {E._id('model_id')} as model from predictions), b as (select distinct {E._id('model_name')} as model from freeform_outputs)
select coalesce(a.model, b.model) as model, a.k is not null as in_a, b.k is not null as in_b from (select model, 1 as k from a) a full join (select model, 1 as k from b) b on a.model is not distinct from b.model""")
def model_overlap(spark, d):
    """Models of the predictions, of the free-form outputs, or of both."""
    a = table(spark, d, "predictions").select(clean_id(F.col("model_id")).alias("model"))
    b = table(spark, d, "freeform_outputs").select(clean_id(F.col("model_name")).alias("model"))
    return reports.overlap(a, b, "model")


_PARTS_SQL = f"lower(trim(part8)) in {tuple(dims.PART8)}"
_RESIDUALS = E._EVIDENCE.split("l as (select")[0].rstrip().rstrip(",").replace("select image_id, array_to_string", "select image_id, annotation_id, array_to_string").replace("e as (select image_id, regexp_extract", "e as (select image_id, annotation_id, regexp_extract")


@query(_RESIDUALS + f""", t as (select distinct image_id, annotation_id, 0 as source from e where kind = 'residual' and side <> '' and segment is not null and image_id is not null union select distinct image_id, annotation_id, 1 from prosthesis_instances where {_PARTS_SQL} and image_id is not null)
select image_id, annotation_id, case source when 0 then 'residual' else 'prosthesis' end as source_type, cast(row_number() over (partition by image_id order by source, annotation_id) - 1 as int) as instance_no from t""")
def running_targets(spark, d):
    """Targets of every image: its residual limbs, then its prostheses, numbered."""
    label = X.evidence_label(F.col("category_name"), **E._RULE)
    a = table(spark, d, "annotations").where(label.endswith("_residual")).select("image_id", "annotation_id", F.lit(0).alias("source"))
    b = table(spark, d, "prosthesis_instances").where(F.lower(F.trim("part8")).isin(dims.PART8)).select("image_id", "annotation_id", F.lit(1).alias("source"))
    t = a.unionByName(b).where("image_id is not null").distinct()
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("source", "annotation_id")) - 1
    return t.select("image_id", "annotation_id", F.when(F.col("source") == 0, "residual").otherwise("prosthesis").alias("source_type"), place.cast("int").alias("instance_no"))


@query(_RESIDUALS + f"""select image_id from e where kind = 'residual' and side <> '' and segment is not null and image_id is not null union select image_id from prosthesis_instances where {_PARTS_SQL} and image_id is not null""")
def evidence_images(spark, d):
    """Images with a residual limb or a prosthesis."""
    return running_targets(spark, d).select("image_id").distinct()


@query(E._OPTIONS + """, r as (select model, delivery_id, row_number() over (partition by model order by delivery_id) as place from sc where exact = 0 and model is not null)
select model, cast(place as int) as place, delivery_id from r where place <= 3""")
def wrong_rows(spark, d):
    """The first three wrong answers of each model, in order of delivery."""
    rows = E.option_sets(spark, d).where("exact = 0 and model is not null").select("model", "delivery_id")
    place = F.row_number().over(Window.partitionBy("model").orderBy("delivery_id"))
    return rows.withColumn("place", place).where("place <= 3").select("model", "place", "delivery_id")


@query(f"""with ranked as (select {E._id('item_id')} as key, *, row_number() over (partition by {E._id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null)
select key, coalesce(case when options_grid.enabled then options_grid.path end, 'grids/' || regexp_replace(key, '[^A-Za-z0-9._-]', '_', 'g') || '.png') as grid_path from ranked where rn = 1""")
def grid_paths(spark, d):
    """Where the option grid of every current item lies: its own path if it has one, else that of the manifest."""
    b = table(spark, d, "benchmark_items").where("item_id is not null").select(clean_id(F.col("item_id")).alias("key"), "options", "options_grid", "loaded_at", "item_row")
    items = scoring.last_per_key(b, ["key"], ["loaded_at", "item_row"])
    own = F.when(F.col("options_grid.enabled"), F.col("options_grid.path"))
    return images.with_grids(items, images.grid_manifest(items, "key", "options", "grids"), "key", own).select("key", "grid_path")


# ---- census of queries and options ---------------------------------------------------------------

@query(E.ORACLE["evidence_queries"].replace("select task_name, image_id, group_id, cast(i - 1 as int)", "select task_name, coalesce(target_answer, 'labels') as answer, count(*) as n from (select task_name, image_id, group_id, cast(i - 1 as int)") + ") group by 1, 2")
def task_counts(spark, d):
    """How many evidence queries each task and answer has."""
    return E.evidence_queries(spark, d).groupBy("task_name", F.coalesce("target_answer", F.lit("labels")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query(E.ORACLE["evidence_queries"].replace("select task_name, image_id, group_id, cast(i - 1 as int)", "select image_id, arg_min(group_id, task_name) as group_id, list_sort(list_distinct(list(task_name))) as tasks from (select task_name, image_id, group_id, cast(i - 1 as int)") + ") group by 1")
def image_tasks(spark, d):
    """The tasks asked of every image, with its first group."""
    return lookups.gathered(E.evidence_queries(spark, d), "image_id", ["group_id"], "task_name", ["task_name", "group_id"])


@query(f"""with ranked as (select {E._id('item_id')} as key, *, row_number() over (partition by {E._id('item_id')} order by loaded_at desc nulls last, item_row desc) as rn from benchmark_items where item_id is not null),
o as (select key, unnest(options) as o from ranked where rn = 1)
select o.option_id as option_id, count(*) as n, count(distinct key) as items, bool_and(starts_with(key, 'compatibility_category')) as all_category from o where o is not null group by 1""")
def option_census(spark, d):
    """Option ids of current items: how often, in how many items, and whether in category items alone."""
    rows = E.current_items(spark, d).select("key", F.explode("options").alias("o")).where("o is not null")
    return rows.groupBy(F.col("o.option_id").alias("option_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("items"), F.bool_and(F.col("key").startswith("compatibility_category")).alias("all_category"))


@query("""select event_id from events where event_type = 'purchase' order by md5('7:' || event_id::varchar), event_id limit 25""")
def restricted_sample(spark, d):
    """Twenty-five purchases in md5 order: the sample a trial run is asked for."""
    return lookups.restricted(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type") == "purchase", "event_id", 25, seed=7).select("event_id")
