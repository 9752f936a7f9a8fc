"""Control baselines, drawn items, coupling of several tasks, audits and the report layer."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import controls, reports, sampling, statistics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_baselines_of_single_choice(spark):
    items = frame(spark, [(i, "b" if i % 3 else "c") for i in range(300)] + [(400, None)], "item int, gold string")
    got = {b: [r.pred for r in controls.single_choice_baseline(items, "item", "gold", b, list("abcd")).orderBy("item").collect()] for b in ("random", "label_freq_prior", "answer_count_prior", "always_none")}
    assert set(got["label_freq_prior"]) == {"b"} and set(got["answer_count_prior"]) == {"a"} and set(got["always_none"]) == {None}
    assert set(got["random"]) == set("abcd") and max(Counter(got["random"]).values()) < 110
    assert got["random"] == [r.pred for r in controls.single_choice_baseline(items.repartition(5), "item", "gold", "random", list("abcd")).orderBy("item").collect()]
    with pytest.raises(ValueError):
        controls.single_choice_baseline(items, "item", "gold", "top_k_frequent", list("abcd"))
    assert controls.single_choice_baseline(items.limit(0), "item", "gold", "label_freq_prior", list("abcd")).count() == 0


def test_baselines_of_option_sets_and_free_text(spark):
    rows = [(1, ["A"], ["A", "B", "C"]), (2, ["B", "A"], ["C", "B"]), (3, ["A"], ["C"]), (4, [], [])]
    items = frame(spark, rows, "item int, gold array<string>, opts array<string>")
    pred = lambda b: {r.item: r.pred for r in controls.option_set_baseline(items, "item", "gold", "opts", b).collect()}
    assert pred("label_freq_prior") == {1: ["A"], 2: ["B"], 3: [], 4: []}
    assert pred("answer_count_prior") == {1: ["A"], 2: ["C"], 3: ["C"], 4: []} and set(map(tuple, pred("always_none").values())) == {()}
    assert all(set(p) <= set(o) for (_, _, o), p in zip(rows, pred("random").values()))
    text = lambda b: {r.item: r.raw_output for r in controls.free_text_baseline(items, "item", "gold", b).collect()}
    assert set(text("label_freq_prior").values()) == {"A"} and set(text("top_k_frequent").values()) == {"A, B"} and set(text("always_none").values()) == {""}
    assert set(text("answer_count_prior").values()) == {"A"} and set(text("random").values()) <= {"A", "B", "A, B"}
    assert controls.free_text_baseline(items.limit(0), "item", "gold", "random").count() == 0
    runs = {(r.variant, r.baseline) for r in controls.baseline_runs(spark).collect()}
    assert ("attribution_freeform", "top_k_frequent") in runs and ("presence", "top_k_frequent") not in runs and len(runs) == 21


def test_an_audit_fails_closed(spark):
    records = frame(spark, [("a",), ("b",), (None,)], "key string")
    good = frame(spark, [("a", True), ("b", True), ("a", True)], "key string, ok boolean")
    assert controls.verified_pairs(good, records, "key", "ok").count() == 3
    for bad, counts in (([("a", False)], (1, 1, 0)), ([("a", None)], (1, 1, 0)), ([("z", True)], (1, 0, 1)), ([(None, True), ("a", True)], (2, 0, 1))):
        pairs = frame(spark, bad, "key string, ok boolean")
        r = controls.paired_audit(pairs, records, "key", "ok").first()
        assert (r.n_pairs, r.ineligible, r.missing, r.passes) == (*counts, False)
        with pytest.raises(ValueError):
            controls.verified_pairs(pairs, records, "key", "ok")
    assert controls.paired_audit(good.limit(0), records, "key", "ok").first().passes


def test_a_drawn_number_of_right_options(spark):
    """As many right options as drawn, hard ones for half the rest, cross ones for what is left and for what is short."""
    parts = ["arm_upper", "arm_lower", "leg_upper", "leg_lower"]
    pool = frame(spark, [(i, parts[i % 4], 100 + i) for i in range(80)] + [(1000, "arm_upper", 5)], "option_id int, coarse string, option_source int")
    targets = frame(spark, [(i, "arm_upper", 5, i % 5) for i in range(100)] + [(200, "other", 5, 1)], "item int, coarse string, source int, num_correct int")
    rows = sampling.draw_variable(targets, pool, 8, "num_correct", 0.5, "item", "source").collect()
    counts = Counter((r.item, r.kind) for r in rows)
    for i in range(100):
        c = i % 5
        assert (counts[i, "positive"], counts[i, "hard"], counts[i, "cross"]) == (c, (8 - c) // 2, 8 - c - (8 - c) // 2)
    assert all(r.option_id != 1000 for r in rows) and {r.item for r in rows} == set(range(100)) and len({(r.item, r.option_id) for r in rows}) == 800
    few = pool.where("coarse = 'arm_upper' and option_id < 8 or coarse = 'leg_upper'")  # two right ones, no hard ones
    short = Counter(r.kind for r in sampling.draw_variable(targets.where("item = 4"), few, 8, "num_correct", 0.5, "item", "source").collect())
    assert short == {"positive": 2, "cross": 6}
    drawn = [r.n for r in spark.range(5000).select(sampling.drawn_num_correct(F.col("id").cast("string"), 0.2, 0, 4).alias("n")).collect()]
    share = Counter(drawn)
    assert set(share) == {0, 1, 2, 3, 4} and abs(share[0] / 5000 - 0.2) < 0.03 and all(abs(share[k] / 5000 - 0.2) < 0.03 for k in (1, 2, 3, 4))


def test_coupling_of_three_tasks(spark):
    long = frame(spark, [(t, k, ok) for t, oks in {"a": [1, 0, 0, 1], "b": [1, 0, 1, None], "c": [0, 0, None, None]}.items() for k, ok in enumerate(oks) if ok is not None], "task string, k int, correct int").withColumn("correct", F.col("correct") == 1)
    got = {(r.task_a, r.task_b): r for r in statistics.coupling_report(long, "k").collect()}
    assert len(got) == 9 and got["a", "a"].p_b_wrong_given_a_wrong == 1.0 and got["a", "a"].phi is None and got["a", "a"].n == 4 and got["a", "a"].both_wrong == 2
    assert (got["a", "b"].n, got["a", "b"].both_wrong, got["a", "b"].p_b_wrong_given_a_wrong) == (3, 1, 0.5) and got["b", "a"].p_b_wrong_given_a_wrong == 1.0
    assert got["a", "c"].n == 2 and got["a", "b"].phi == got["b", "a"].phi == pytest.approx(0.5)
    few = frame(spark, [("m1", 1.0, 2.0), ("m2", 2.0, 3.0), ("m3", None, 1.0)], "model string, x double, y double")
    assert tuple(statistics.ranking_agreement(few, "x", "y").first()) == (2, None, None)
    assert tuple(statistics.ranking_agreement(few.fillna(9.0), "x", "y").first()) == pytest.approx((3, -0.5, -1 / 3))


def test_metrics_are_found_by_their_type(spark):
    runs = frame(spark, [("m", 1, 0.5, "x", 9.0), ("m", 3, None, "y", 9.0), ("n", 2, 0.25, "z", 9.0)], "model string, a int, b double, note string, _hidden double")
    got = {(r.model, r.metric): r for r in statistics.metrics_by_run(runs, ["model"]).collect()}
    assert set(got) == {("m", "a"), ("m", "b"), ("n", "a"), ("n", "b")}
    assert got["m", "a"].n == 2 and got["m", "a"]["mean"] == 2.0 and got["m", "a"].ci_upper == pytest.approx(2 + 12.706204736 * 1.0, abs=1e-6)
    assert (got["m", "b"].n, got["m", "b"].ci_lower, got["m", "b"].ci_upper) == (1, 0.5, 0.5)
    assert {r.metric for r in statistics.metrics_by_run(runs, ["model"], ["b"]).collect()} == {"b"}


def test_reports_are_taken_apart_and_put_together(spark, tmp_path):
    coverage = {"report_type": "parse_coverage", "variant": "v", "per_model": {"m1": {"parse_success_rate": 0.5}, "m2": {"parse_success_rate": 1.0}}}
    shuffle = {"variant": None, "per_model": {"m1": {"summary": {"jaccard": 0.25}}}}
    for name, doc in (("c", coverage), ("s", shuffle), ("o", {"variant": "v", "model_name": "m1", "overall": {"exact_accuracy": 0.75}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    read = lambda name, schema: spark.read.schema(schema).json(str(tmp_path / f"{name}.json"))
    c = reports.per_model(read("c", "variant string, per_model map<string,struct<parse_success_rate:double>>"), fields=["parse_success_rate"])
    assert sorted(map(tuple, c.collect())) == [("v", "m1", 0.5), ("v", "m2", 1.0)]
    s = reports.per_model(read("s", "variant string, per_model map<string,struct<summary:struct<jaccard:double>>>"), fields=["jaccard"], inner="summary")
    assert list(map(tuple, s.collect())) == [("unknown_variant", "m1", 0.25)]
    o = reports.overall(read("o", "variant string, model_name string, overall struct<exact_accuracy:double>"), ["exact_accuracy", "avg_f1"])
    assert list(map(tuple, o.collect())) == [("v", "m1", 0.75, None)]
    merged = reports.upsert(["variant", "model"], o=o, c=c, s=s)
    assert {(r.variant, r.model): (r.exact_accuracy, r.parse_success_rate, r.jaccard) for r in merged.collect()} == {("v", "m1"): (0.75, 0.5, None), ("v", "m2"): (None, 1.0, None), ("unknown_variant", "m1"): (None, None, 0.25)}
    text = reports.full_report("Runs", key_metrics=o.select("model", "exact_accuracy"), coverage=c.orderBy("model").select("model", "parse_success_rate"))
    assert text.startswith("# Runs\n\n## key metrics\n\n| model | exact_accuracy |") and "| m2 | 1.000 |" in text
    counts = {(r.statistic, r.key): r.n for r in reports.histograms(frame(spark, [("a", 1), ("a", None), ("b", 1)], "x string, y int"), x=F.col("x"), y=F.col("y")).collect()}
    assert counts == {("x", "a"): 2, ("x", "b"): 1, ("y", "1"): 2, ("y", "unknown"): 1}
    both = {r.k: (r.in_a, r.in_b) for r in reports.overlap(frame(spark, [("p",), (None,), ("p",)], "k string"), frame(spark, [("q",), (None,)], "k string"), "k").collect()}
    assert both == {"p": (True, False), "q": (False, True), None: (True, True)}


def test_what_charts_draw_and_errors_tell(spark):
    from gaugeloom import charts, errors

    df = frame(spark, [("m", 10, 0.5), ("m", 2, 0.25), ("n", 2, None)], "model string, k int, v double")
    groups, series = charts.grouped_rows(df, "k", "model", "v")
    assert groups == [2, 10] and series["m"] == [0.25, 0.5] and all(x != x for x in series["n"])
    angles, outlines = charts.radar_rows(frame(spark, [("m", 1.0, None, 0.5)], "model string, a double, b double, c double"), "model", ["a", "b", "c"])
    assert len(angles) == 4 and angles[0] == angles[-1] == 0 and outlines == {"m": [1.0, 0.0, 0.5, 1.0]}
    with pytest.raises(ValueError):
        charts.radar_rows(df, "model", ["k", "v"])
    with pytest.raises(errors.DataError, match="reading failed.*path='p'") as e:
        with errors.error_context(errors.DataError, "reading failed", path="p"):
            raise KeyError("x")
    assert e.value.details == {"path": "p"} and isinstance(e.value.__cause__, KeyError)
    with pytest.raises(errors.ModelError) as e:
        with errors.error_context(errors.DataError, "outer", item=1):
            raise errors.ModelError("no answer", model="m")
    assert e.value.details == {"item": 1, "model": "m"}


def test_grids_are_joined_to_their_items(spark):
    from gaugeloom import images

    items = frame(spark, [("a:1", [("A", "x.png"), None, ("B", None)], "own.png"), ("b", None, None)], "item string, options array<struct<option_id:string,path:string>>, own string")
    manifest = images.grid_manifest(items, "item", "options", "grids/")
    assert [tuple(r) for r in manifest.orderBy("item").collect()] == [("a:1", "grids/a_1.png", ["A"], ["x.png"]), ("b", "grids/b.png", None, None)]
    got = {r.item: r.grid_path for r in images.with_grids(items, manifest.where("item = 'b'"), "item", F.col("own")).collect()}
    assert got == {"a:1": "own.png", "b": "grids/b.png"} and images.with_grids(items, manifest.limit(0), "item").where("grid_path is null").count() == 2


def test_lookups_fail_loudly(spark):
    from gaugeloom.operators import lookups

    df = frame(spark, [(1, "a", ["x"], None), (2, "a", [], 3), (3, "a", None, None)], "k int, v string, labels array<string>, n int")
    assert lookups.point(df, "k", 2).first().n == 3 and lookups.probe(df, "k", 9).count() == 0
    with pytest.raises(KeyError):
        lookups.point(df, "k", 9)
    assert lookups.only_value(df, "v") == "a"
    for bad in ("k", "n"):
        with pytest.raises(ValueError):
            lookups.only_value(df, bad)
    with pytest.raises(ValueError, match="not supported: z"):
        lookups.unsupported(["x", "z", "z"], ["x", "y"])
    lookups.unsupported([], ["x"])
    assert [r.c for r in df.select(lookups.gold_count(F.col("n"), F.col("labels")).alias("c")).orderBy("c").collect()] == [0, 1, 3]
    assert [r.s for r in df.orderBy("k").select(lookups.label_space(F.col("labels"), ["p", "q"]).alias("s")).collect()] == [["x"], ["p", "q"], ["p", "q"]]
    names = frame(spark, [(" Attribution_x ",), ("compatibility_category",), (None,), ("presence",)], "v string")
    assert [tuple(r) for r in names.select(lookups.is_attribution(F.col("v")), lookups.is_compatibility(F.col("v"))).collect()] == [(True, False), (False, True), (False, False), (False, False)]
    assert [r.k for r in lookups.restricted(df, F.col("k") > 1, "k", 1).collect()] == [2] and lookups.restricted(df, F.lit(True), "k", 2, seed=1).count() == 2
    rows = frame(spark, [(1, "t2", "late", 5), (1, "t1", "first", 1), (1, "t1", "x", 2), (2, "t1", "y", 1)], "k int, task string, path string, o int")
    assert sorted(map(tuple, lookups.gathered(rows, "k", ["path"], "task", ["o"]).collect())) == [(1, "first", ["t1", "t2"]), (2, "y", ["t1"])]
    p = df.select("*").withColumns(lookups.prediction_record(F.col("k"), F.col("v"), "m", None, L_array("b", "c"), F.col("k") == 1)).orderBy("k").collect()
    assert p[0].choices == ["b", "c"] and p[0].prediction_labels is None and p[0].parser_status is None and p[0].answer_space_type == "constrained"
    assert p[1].choices is None and p[1].prediction_labels == ["b", "c"] and p[1].unresolved_tokens == [] and p[1].answer_count_predicted == 2


def L_array(*values):
    return F.array(*[F.lit(v) for v in values])
