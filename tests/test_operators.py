import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import labels as L
from gaugeloom.operators import construction, reports, sampling, scoring, statistics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_null_safe_match_and_last_per_key(spark):
    p = frame(spark, [(1, None, "x"), (2, "k", "y"), (3, "none", "z")], "id int, k string, v string")
    g = frame(spark, [(None, 10), ("k", 20)], "k string, g int")
    assert sorted((r.id, r.g) for r in scoring.match_gold(p, g, ["k"]).collect()) == [(1, 10), (2, 20)]
    c = scoring.coverage(p, frame(spark, [(None, 1), ("k", 1), ("q", 1)], "k string, g int"), ["k"]).first()
    assert (c.matched, c.without_gold, c.gold_without_prediction) == (2, 1, 1)
    rows = frame(spark, [("a", 1, "old"), ("a", 2, None), ("b", 1, "only"), (None, 3, "n")], "k string, o int, v string")
    assert sorted(map(str, ((r.k, r.v) for r in scoring.last_per_key(rows, ["k"], ["o"]).collect()))) == sorted(map(str, [("a", None), ("b", "only"), (None, "n")]))


ROWS = [("g1", ["a"], ["a"], 0), ("g1", ["a"], ["b"], 0), ("g2", ["a", "b"], ["a"], 0), ("g2", ["a", "b"], ["a"], 1), ("g3", [], [], 1), ("g4", ["b"], [], 0)]


def scored_rows(spark):
    df = frame(spark, ROWS, "grp string, gold array<string>, pred array<string>, parse_error int").withColumn("signature", F.to_json("pred"))
    return scoring.scored(df)


def test_gate_and_groups(spark):
    got = {r.grp: r for r in scoring.group_summary(scored_rows(spark), ["grp"]).collect()}
    assert (got["g1"].group_any_correct, got["g1"].group_all_correct, got["g1"].group_consistency, got["g1"].counted) == (True, False, 0.0, True)
    assert (got["g2"].group_any_correct, got["g2"].group_consistency, got["g2"].counted) == (False, 1.0, False)
    assert got["g3"].group_consistency == 1.0 and got["g3"].counted and not got["g4"].counted
    s = scoring.gated_summary(scored_rows(spark), [], ["grp"], True).first()
    assert (s.num_samples, s.raw_num_samples, s.num_groups, s.num_groups_excluded) == (3, 6, 2, 2) and abs(s.avg_exact - 2 / 3) < 1e-12
    assert scoring.gated_summary(scored_rows(spark), [], ["grp"], False).first().num_samples == 6
    assert scoring.gated_summary(scored_rows(spark).limit(0), [], ["grp"], True).first().num_samples == 0
    rows = scoring.with_group(scored_rows(spark), ["grp"])
    assert rows.count() == 6 and rows.where("counted").count() == 3
    one = scoring.gated_label_scores(scored_rows(spark), ["grp"]).first()
    kept = rows.where("counted")
    assert tuple(scoring.micro_macro(scoring.label_counts(kept)).first()) == tuple(one)[6:] and one.num_samples == 3 and abs(one.set_miou - 2 / 3) < 1e-12


def test_label_counts_and_averages(spark):
    counts = {r.label: (r.tp, r.fp, r.fn) for r in scoring.label_counts(scored_rows(spark)).collect()}
    assert counts == {"a": (3, 0, 1), "b": (0, 1, 3)}
    m = scoring.micro_macro(scoring.label_counts(scored_rows(spark))).first()
    assert abs(m.micro_precision - 3 / 4) < 1e-12 and abs(m.micro_recall - 3 / 7) < 1e-12 and abs(m.macro_precision - 0.5) < 1e-12
    filled = scoring.with_all_labels(scoring.label_counts(scored_rows(spark)), frame(spark, [("a",), ("z",)], "label string"))
    assert {r.label: r.tp for r in filled.collect()} == {"a": 3, "b": 0, "z": 0}
    assert tuple(scoring.micro_macro(scoring.label_counts(scored_rows(spark).limit(0))).first()) == (0.0,) * 6


def test_consistency_conventions(spark):
    df = frame(spark, [("g", "a", 1.0), ("g", None, 0.0), ("g", "a", 1.0), ("h", None, 0.0), ("i", "b", 0.0)], "grp string, pred string, exact double")
    a = scoring.mean_consistency(df, ["grp"], "pred").first()
    assert tuple(a) == (1, 1, 1.0)
    b = scoring.mean_consistency(df, ["grp"], "pred", skip_null=False).first()
    assert tuple(b) == (1, 2, 0.5)
    assert tuple(scoring.mean_consistency(df, ["grp"], "pred", gate=False, least=5, if_none=1.0).first()) == (0, 0, 1.0)


def test_confusion_keeps_empty_cells(spark):
    df = frame(spark, [("a", "b"), ("a", "b"), ("a", "a")], "t string, p string")
    cells = {(r.target, r.pred): (r.n, r.row_share, r.col_share, r.share) for r in scoring.normalized(scoring.confusion(df, "t", "p", ["a", "b"], ["a", "b"])).collect()}
    assert cells[("a", "b")] == (2, 2 / 3, 1.0, 2 / 3) and cells[("b", "a")] == (0, 0.0, 0.0, 0.0) and len(cells) == 4


def test_single_choice(spark):
    df = frame(spark, [("a", "a"), ("a", None), ("b", "a"), ("zz", "a"), ("c", "x")], "gold string, pred string")
    s = scoring.single_choice_summary(df, list("abc")).first()
    assert s.num_samples == 5 and abs(s.accuracy - 1 / 5) < 1e-12 and s.parse_error_count == 2
    per = {r.label: (r.tp, r.fp, r.fn) for r in scoring.single_choice_classes(df, list("abc")).collect()}
    assert per == {"a": (1, 1, 1), "b": (0, 0, 1), "c": (0, 0, 1)}


def rank(values):
    return [1 + sum(w < v for w in values) + (sum(w == v for w in values) - 1) / 2 for v in values]


def test_correlations_against_brute_force(spark):
    rng = random.Random(1)
    for n in (2, 3, 25):
        x, y = [float(rng.randrange(6)) for _ in range(n)], [float(rng.randrange(6)) for _ in range(n)]
        df = frame(spark, list(zip(range(n), x, y)), "i int, x double, y double")
        got = {r.i: r["rank"] for r in statistics.average_rank(df, "x").collect()}
        assert [got[i] for i in range(n)] == rank(x)

        def pearson(a, b):
            ma, mb = sum(a) / n, sum(b) / n
            den = math.sqrt(sum((i - ma) ** 2 for i in a) * sum((j - mb) ** 2 for j in b))
            return sum((i - ma) * (j - mb) for i, j in zip(a, b)) / den if den else 0.0

        assert abs(df.agg(statistics.pearson(F.col("x"), F.col("y")).alias("r")).first().r - pearson(x, y)) < 1e-9
        assert abs(statistics.spearman(df, "x", "y").first()[0] - pearson(rank(x), rank(y))) < 1e-9
        sign = lambda v: (v > 0) - (v < 0)
        s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i in range(n) for j in range(i))
        ties = lambda v: sum(c * (c - 1) // 2 for c in Counter(v).values())
        den = math.sqrt((n * (n - 1) // 2 - ties(x)) * (n * (n - 1) // 2 - ties(y)))
        assert abs(statistics.kendall_tau_b(df, "x", "y").first()[0] - (s / den if den else 0.0)) < 1e-9


def test_tau_and_ranks_over_many_ranges(spark):
    """Ties, a value held by a third of the rows, and many distinct values: as by looking at every pair."""
    import numpy as np

    rng = np.random.default_rng(7)
    for n, kind in ((400, "distinct"), (900, "ties"), (600, "hot"), (5, "same")):
        x = {"distinct": rng.permutation(n), "ties": rng.integers(0, 40, n), "hot": np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 500, n)), "same": np.zeros(n)}[kind].astype(float)
        y = np.round(x * 0.5 + rng.normal(0, n / 4, n)) if kind != "same" else np.arange(n).astype(float)
        df = frame(spark, [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
        i, j = np.triu_indices(n, 1)
        sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        den = math.sqrt((sx != 0).sum() * (sy != 0).sum())
        want = (sx * sy).sum() / den if den else 0.0
        for ranges in (4, 64):
            assert abs(statistics.kendall_tau_b(df, "x", "y", ranges).first()[0] - want) < 1e-9, (kind, ranges)
        got = {r.i: r["rank"] for r in statistics.average_rank(df, "x").collect()}
        assert [got[k] for k in range(n)] == rank(list(x))
    nulls = frame(spark, [(1, None), (2, 5.0), (3, None), (4, 1.0)], "i int, x double")
    assert {r.i: r["rank"] for r in statistics.average_rank(nulls, "x").collect()} == {1: 1.5, 3: 1.5, 4: 3.0, 2: 4.0}


def test_coupling(spark):
    counts = frame(spark, [(10, 4, 2, 1, 3), (4, 4, 0, 0, 0)], "n int, both_correct int, a_correct_b_wrong int, a_wrong_b_correct int, both_wrong int")
    a, b = statistics.coupling(counts).orderBy("n").collect()[::-1]
    assert abs(a.phi - (4 * 3 - 2 * 1) / math.sqrt(6 * 4 * 5 * 5)) < 1e-12 and a.p_b_wrong_given_a_wrong == 0.75
    mi = sum(c / 10 * math.log2(c * 10 / (r * s)) for c, r, s in ((4, 6, 5), (2, 6, 5), (1, 4, 5), (3, 4, 5)))
    assert abs(a.mutual_info_bits - mi) < 1e-12
    assert (b.phi, b.mutual_info_bits, b.p_b_wrong_given_a_wrong) == (0.0, 0.0, None)
    long = frame(spark, [("t1", 1, True), ("t2", 1, False), ("t3", 1, True), ("t1", 2, False), ("t2", 2, False)], "task string, k int, correct boolean")
    pairs = {(r.task_a, r.task_b): (r.n, r.both_wrong) for r in statistics.task_pairs(long, "k").collect()}
    assert pairs == {("t1", "t2"): (2, 1), ("t1", "t3"): (1, 0), ("t2", "t3"): (1, 0)}


def drawn(rep, slot, n):
    """The place that a slot draws in a replicate."""
    import hashlib

    return int(hashlib.md5(f"{rep // 4}:{slot}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16) % n


def test_bootstrap(spark):
    rng = random.Random(2)
    values = [rng.randrange(3) for _ in range(200)]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v int")
    reps = statistics.bootstrap_sums(df.select("v"), ["v"], replicates=40).collect()
    assert len(reps) == 40
    ordered = sorted(values)
    for r in reps:
        draw = [ordered[drawn(r.rep, s, 200)] for s in range(200)]
        assert (r.n, r.v) == (200, sum(draw))
    weights = statistics.poisson_bootstrap_sums(df, ["v"], "i", replicates=200).agg(F.avg("n").alias("n"), F.avg(F.col("v") / F.col("n")).alias("m"), F.stddev("n").alias("s")).first()
    assert abs(weights.n - 200) < 5 and abs(weights.m - sum(values) / 200) < 0.02 and 11 < weights.s < 18
    ci = statistics.interval(frame(spark, [(float(i),) for i in range(101)], "m double"), "m").first()
    assert abs(ci.ci_lower - 2.5) < 1e-9 and abs(ci.ci_upper - 97.5) < 1e-9


def test_welch_and_intervals(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 9.0), ("c", 5.0)], "m string, v double")
    rows = statistics.welch_tests(df, "m", "v").collect()
    assert [(r.model_a, r.model_b) for r in rows] == [("a", "b")]
    r = rows[0]
    va, vb = 1 / 3, 13 / 3
    assert abs(r.t - (2 - 5) / math.sqrt(va + vb)) < 1e-9 and abs(r.df - (va + vb) ** 2 / (va**2 / 2 + vb**2 / 2)) < 1e-9 and 0.2 < r.p < 0.35 and not r.significant
    ci = {x.m: x for x in statistics.confidence_interval(df, "v", ["m"]).collect()}
    assert (ci["c"].std, ci["c"].ci_lower, ci["c"].ci_upper) == (0.0, 5.0, 5.0) and abs(ci["a"].ci_upper - (2 + 4.30265 / math.sqrt(3))) < 1e-3


def test_sampling(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("item"), F.array(*[F.lit(c) for c in "abcdef"]).alias("space"))
    out = df.select("item", "space", sampling.take_k(F.col("space"), F.lit(2), F.col("item")).alias("k"), sampling.random_subset(F.col("space"), F.col("item")).alias("r"), sampling.random_subset(F.col("space"), F.col("item"), allow_empty=False).alias("n"), sampling.take_k(F.col("space"), F.lit(99), F.col("item")).alias("all"))
    rows = out.collect()
    assert all(len(set(r.k)) == 2 and r.k == sorted(r.k) and r["all"] == sorted(r.space) and len(r.n) >= 1 for r in rows)
    assert set(Counter(len(r.r) for r in rows)) == set(range(7)) and len({tuple(r.k) for r in rows}) > 10
    assert sorted(map(str, out.collect())) == sorted(map(str, out.repartition(7).collect()))  # where a row lies does not matter


def test_permutations(spark):
    for n in (3, 4, 7):
        df = spark.range(20).select("id", F.array(*[F.lit(c) for c in "ABCDEFGH"[:n]]).alias("o"))
        rows = sampling.permuted_copies(df, "id", "o", 3).collect()
        assert len(rows) == 60
        for i in range(20):
            orders = [tuple(r.options) for r in rows if r.id == i]
            assert len(set(orders)) == 3 and tuple("ABCDEFGH"[:n]) not in orders and all(sorted(o) == list("ABCDEFGH"[:n]) for o in orders)
    with pytest.raises(Exception):
        sampling.permuted_copies(spark.range(1).select("id", F.array(F.lit("A"), F.lit("B")).alias("o")), "id", "o", 2).collect()
    ids = sampling.permuted_copies(spark.range(1).select("id", F.array(F.lit("A"), F.lit("B")).alias("o")), "id", "o", 1).collect()
    assert ids[0].record_id == "0::shuffle0" and ids[0].options == ["B", "A"]


def test_shuffle_sensitivity(spark):
    df = frame(spark, [("m", "i", 1.0, 1.0, ["a"]), ("m", "i", 0.0, 0.5, ["b"]), ("m", "j", 1.0, 1.0, ["a"])], "m string, b string, exact double, f1 double, s array<string>")
    r = sampling.shuffle_sensitivity(df, "m", "b", "s").first()
    assert (r.num_items, r.selected_set_jaccard_mean, r.exact_std_mean, r.f1_std_mean) == (2, 0.5, 0.25, 0.125)


def test_baselines(spark):
    df = frame(spark, [(1, ["a", "b"], ["a", "b", "c"]), (2, ["a"], ["b", "c"]), (3, ["b", "a"], ["a"])], "i int, gold array<string>, space array<string>")
    pred = lambda name: {r.i: r.pred for r in sampling.baseline_predictions(df, "i", "gold", "space", name).collect()}
    assert pred("label_freq_prior") == {1: ["a", "b"], 2: ["b"], 3: ["a"]} and pred("always_none") == {1: [], 2: [], 3: []} and pred("top_k_frequent")[2] == ["a", "b"]
    assert {len(v) for v in pred("answer_count_prior").values()} == {2, 1} and all(set(v) <= {"a", "b", "c"} for v in pred("random").values())
    with pytest.raises(ValueError):
        pred("other")


def test_reports(spark):
    df = frame(spark, [("v", "m2", 0.5), ("v", "m1", 0.5), ("w", "m1", None)], "variant string, model string, value double")
    assert [tuple(r) for r in reports.best_per(df, "variant", "value", "model").collect()] == [("v", "m1", 0.5)]
    m = reports.matrix(df, "model", "variant", "value", ["v", "w", "x"]).orderBy("model")
    assert [tuple(r) for r in m.collect()] == [("m1", 0.5, None, None), ("m2", 0.5, None, None)]
    assert reports.markdown(m).splitlines()[2] == "| m1 | 0.500 | NA | NA |"
    assert [r.model for r in reports.baselines_first(frame(spark, [("z",), ("baseline_b",), ("a",)], "model string"), "model").collect()] == ["baseline_b", "a", "z"]
    merged = reports.upsert(["k"], a=frame(spark, [(1, 2)], "k int, x int"), b=frame(spark, [(1, 3), (2, 4)], "k int, y int"))
    assert sorted(map(tuple, merged.collect())) == [(1, 2, 3), (2, None, 4)]


COCO = {
    "images": [{"id": 1, "file_name": "a.png", "width": 1, "height": 1}, {"id": 2, "file_name": "b.png"}], "categories": [{"id": 7, "name": "left-thigh-residual"}, {"id": 8, "name": "left-calf-functional-pro"}],
    "annotations": [{"id": 1, "image_id": 1, "category_id": 8, "bbox": [0, 0, 2, 4], "area": 8.0}, {"id": 2, "image_id": 1, "category_id": 7}, {"id": 3, "image_id": 1, "category_id": 99}],
}


def test_coco_to_queries(spark, tmp_path):
    import json

    from gaugeloom.sources import readers

    (tmp_path / "coco.json").write_text(json.dumps(COCO))
    images, annotations, categories = construction.flatten_coco(readers.coco(spark, str(tmp_path / "coco.json")))
    named = construction.named_annotations(annotations, categories)
    assert {r.id: (r.category_name, r.area) for r in named.collect()} == {1: ("left-calf-functional-pro", 8.0), 2: ("left-thigh-residual", 0.0), 3: ("unknown", 0.0)}
    assert named.select(construction.xyxy(F.col("bbox")).alias("b")).where("id = 1").first().b == [0, 0, 2, 4]
    evidence = construction.image_evidence(images.select(F.col("id").alias("image_id")), named)
    got = {r.image_id: (r.labels, r.presence_class) for r in evidence.collect()}
    assert got == {1: (["thigh_l_residual", "calf_l_prosthesis"], "residual_and_prosthesis"), 2: ([], "none")}
    q = construction.evidence_queries(evidence, "recognition", ["p", "q", "r"], 2).collect()
    assert len(q) == 2 and {r.target_answer for r in q} == {"c"} and {r.prompt_id for r in q} == {0, 1} and len({r.prompt for r in q}) == 2
    a = construction.evidence_queries(evidence, "attribution", ["p"], 1, keep_empty=True).collect()
    assert {r.image_id: r.target_labels for r in a} == {1: ["thigh_l_residual", "calf_l_prosthesis"], 2: ["none"]}
    with pytest.raises(ValueError):
        construction.evidence_queries(evidence, "attribution", ["p"], 2)


def test_draws_from_a_pool_of_any_size(spark):
    """Options from all parts of the pool, none of the own source, each as likely as another."""
    pool = frame(spark, [(i, ["arm_upper", "arm_lower", "leg_upper", "leg_lower"][i % 4], i % 7 if i % 11 else None) for i in range(400)], "option_id bigint, coarse string, option_source int")
    targets = frame(spark, [(i, "arm_upper", i % 7 if i % 5 else None) for i in range(3000)], "item int, coarse string, source int")
    where, rows = {r.option_id: r for r in pool.collect()}, {r.item: r for r in targets.collect()}
    got = sampling.draw_options(targets, pool, [("positive", "same", 2), ("hard", "hard", 3), ("cross", "cross", 3)], "item", "source").collect()
    assert Counter(Counter((r.item, r.kind) for r in got).values()) == {2: 3000, 3: 6000} and len({(r.item, r.option_id) for r in got}) == len(got)
    kinds = {"positive": {"arm_upper"}, "hard": {"arm_lower"}, "cross": {"leg_upper", "leg_lower"}}
    assert all(where[r.option_id].coarse == r.option_coarse in kinds[r.kind] and where[r.option_id].option_source != rows[r.item].source for r in got)
    seen = Counter(r.option_id for r in got if r.kind == "positive")
    for source in (*range(7), None):  # a source's options are drawn alike: 100 of the part, about 60 a draw each
        counts = [n for o, n in seen.items() if where[o].option_source == source]
        assert counts and 60 * 0.5 < sum(counts) / len(counts) < 60 * 1.6
    assert len(seen) == 100
    again = sampling.draw_options(targets.repartition(5), pool.repartition(3), [("positive", "same", 2), ("hard", "hard", 3), ("cross", "cross", 3)], "item", "source").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    few = pool.where("option_id < 8")  # two options a part, of which the own source leaves fewer
    one = {i: [] for i in range(3000)}
    for r in sampling.draw_options(targets, few, [("positive", "same", 5)], "item", "source").collect():
        one[r.item].append(r.option_id)
    assert all(sorted(v) == [o for o in (0, 4) if where[o].option_source != rows[i].source] for i, v in one.items())
    per = sampling.draw_one_per_part(targets, pool, "item", "source").collect()
    assert len(per) == 12000 and len({(r.item, r.option_coarse) for r in per}) == 12000 and {r.letter for r in per} == set("ABCD")


def test_whole_pool_is_drawn_from(spark):
    from gaugeloom.plans import evaluation

    d = "/root/testdata/sf0.01"
    drawn = {r.option_id for r in evaluation.option_sampling(spark, d).select("option_id").distinct().collect()}
    assert max(drawn) >= 200 and len(drawn) > 1500 and {r.option_id for r in evaluation.category_items(spark, d).collect()} - set(range(200))


def test_no_limit_of_the_pool(spark):
    pool = spark.range(12_000).selectExpr("id as option_id", "'arm_upper' as coarse", "cast(id % 9 as int) as option_source")
    assert sampling.one_option_per_part(frame(spark, [(1, 3)], "item int, source int"), pool, "item", "source").count() == 1


def test_items_of_three_options_are_shuffled(spark, tmp_path):
    """Three options have five other orders; items with fewer than were asked for are reported, none is lost."""
    from gaugeloom.plans import evaluation

    o = lambda *ids: [i and {"option_id": i} for i in ids]
    rows = [("three", o("A", "B", "C")), ("gap", o("A", None, "B", "C")), ("four", o("A", "B", "C", "D")), ("two", o("A", "B")), ("one", o("A", None)), ("none", []), ("null", None)]
    df = frame(spark, [(k, v, n) for n, (k, v) in enumerate(rows)], "item_id string, options array<struct<option_id:string>>, item_row int")
    df.selectExpr("*", "named_struct('path', 'p') as person_image", "named_struct('mode', 'm') as answer", "current_timestamp() as loaded_at").write.parquet(f"{tmp_path}/benchmark_items.parquet")
    got = evaluation.option_shuffle(spark, str(tmp_path)).collect()
    assert Counter(r.item for r in got) == {"three": 3, "gap": 3, "four": 3} and all(len({tuple(r.options) for r in got if r.item == i}) == 3 for i in ("three", "gap", "four"))
    short = {(r.item, r.num_options, r.possible_orders, r.asked) for r in evaluation.option_shuffle_short(spark, str(tmp_path)).collect()}
    assert short == {("two", 2, 1, 3), ("one", 1, 0, 3), ("none", 0, 0, 3), ("null", 0, 0, 3)}


def test_bootstraps_have_a_thousand_replicates(spark, tmp_path):
    import numpy as np

    from gaugeloom.plans import evaluation

    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.choice(["click", "view", "purchase", "signup"]), float(i)) for i in range(30)]
    frame(spark, rows, "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    hits = sorted(int({"click": 0, "view": 1, "purchase": 2, "signup": 3}[r[2]] == r[1] % 4) for r in rows)
    assert 0 < sum(hits) < 30
    means = [sum(hits[drawn(rep, s, 30)] for s in range(30)) / 30 for rep in range(1000)]
    r = evaluation.bootstrap_mean(spark, str(tmp_path)).first()
    want = (sum(hits) / 30, np.std(means, ddof=1), *np.percentile(means, [2.5, 97.5]))
    assert np.allclose((r["mean"], r["std"], r.ci_lower, r.ci_upper), want, atol=2e-9)


def test_places_of_many_equal_rows_are_spread(spark):
    """Values of far more rows than a piece, several sums, nulls and groups: every replicate draws as many rows as there are, as by hand."""
    df = spark.range(200_000).selectExpr("cast(id % 4 > 0 as int) as hit", "id % 2 as odd")
    reps = statistics.bootstrap_sums(df, ["hit", "odd"], replicates=3).collect()
    assert [r.n for r in reps] == [200_000] * 3 and all(abs(r.hit - 150_000) < 1000 and abs(r.odd - 100_000) < 1200 for r in reps)
    rows = [("g", 1, None), ("g", 1, 2), ("g", 0, 5), (None, 3, 1), (None, 3, 1)]
    ordered = {g: sorted(((a, b) for h, a, b in rows if h == g), key=lambda p: (p[0], p[1] is not None, p[1] or 0)) for g in ("g", None)}
    for r in statistics.bootstrap_sums(frame(spark, rows, "g string, a int, b int"), ["a", "b"], ["g"], replicates=6).collect():
        n = len(ordered[r.g])
        drawn_rows = [ordered[r.g][drawn(r.rep, s, n)] for s in range(n)]
        assert (r.n, r.a) == (n, sum(a for a, _ in drawn_rows)) and (r.b or 0) == sum(b or 0 for _, b in drawn_rows)


def test_places_are_not_sent_to_the_driver(spark):
    """bootstrap_micro_f1 broadcast a place per row, as its size was not known to the planner: a broadcast holds no more than the distinct rows."""
    df = spark.range(400_000).selectExpr("cast(id % 5 as int) as v", "cast(id % 3 as int) as w")
    reps = statistics.bootstrap_sums(df, ["v", "w"], replicates=2)
    assert [r.n for r in reps.collect()] == [400_000] * 2
    sent, todo = [], [reps._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind == "BroadcastQueryStageExec":
            todo.append(node.plan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "BroadcastExchangeExec":
            sent.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert sent and max(sent) <= 15


def test_draws_for_many_distinct_rows(spark, monkeypatch):
    """Distinct rows that are held in parts, more of them than slots that draw together, weights, fractions and nulls: every replicate as by hand."""
    monkeypatch.setattr(statistics, "TABLE", 40)
    monkeypatch.setattr(statistics, "SLOTS", 16)
    rng = random.Random(6)
    rows = [(rng.randrange(-2, 3) << 50, rng.choice([None, 0.5, float(i), i / 8]), rng.choice([1, 1, 4])) for i in range(150)]
    ordered = sorted(((a, b) for a, b, w in rows for _ in range(w)), key=lambda p: (p[0], p[1] is not None, p[1] or 0))
    n = len(ordered)
    assert n > 200 and len(set(ordered)) >= 2 * 40
    reps = statistics.bootstrap_sums(frame(spark, rows, "a bigint, b double, w int"), ["a", "b"], replicates=7, weight="w").collect()
    assert sorted(r.rep for r in reps) == list(range(7))
    for r in reps:
        mine = [ordered[drawn(r.rep, s, n)] for s in range(n)]
        assert (r.n, r.a) == (n, sum(a for a, _ in mine)) and abs(r.b - sum(b or 0 for _, b in mine)) < 1e-6
    nothing = statistics.bootstrap_sums(frame(spark, [(1, None)] * 3, "a int, b double"), ["a", "b"], replicates=2).collect()
    assert [(r.n, r.a, r.b) for r in nothing] == [(3, 3, None)] * 2
    assert statistics.bootstrap_sums(frame(spark, [], "a int"), ["a"], replicates=2).collect() == []


def test_draws_from_more_places_than_numbers():
    """More places than 2^32, and places of another part: numbers are places as they are, other places count nothing."""
    import numpy as np

    n, rows = 6_000_000_000, 50
    starts = np.linspace(1 << 30, 5_000_000_000, rows).astype(np.int64)
    values = np.arange(rows) * 10
    (whole, _) = statistics.place_sums(starts, 5_500_000_000, [[np.ones(rows, np.int64), values], []], n, 99_990, 100_040, 6)
    for rep in range(6):
        at = np.array([drawn(rep, s, n) for s in range(99_990, 100_040)])
        at = at[at >= starts[0]]
        assert whole[rep].tolist() == [len(at), int(values[np.searchsorted(starts, at, "right") - 1].sum())]
    (whole, _) = statistics.place_sums(np.array([0, 1]), 2, [[np.array([1 << 62, -(1 << 62)])], []], 2, 0, 30, 4)
    assert whole[:, 0].tolist() == [sum((1, -1)[drawn(rep, s, 2)] << 62 for s in range(30)) for rep in range(4)]


def test_md5_of_numbered_texts():
    import hashlib

    from gaugeloom.functions.md5 import numbered

    prefixes = ["0:", "9:", "10:", "249:", "2500:", "12345:", "999999999:"]
    for first, last in ((0, 12), (9_998, 10_003), (1 << 40, (1 << 40) + 3)):
        at = {p: first for p in prefixes}
        for some, parts in numbered(prefixes, first, last):
            for i, p in enumerate(some):
                for j in range(parts[0].shape[1]):
                    assert b"".join(int(x[i, j]).to_bytes(4) for x in parts).hex() == hashlib.md5(f"{p}{at[p] + j}".encode()).hexdigest()
                at[p] += parts[0].shape[1]
        assert set(at.values()) == {last}


def test_registered_replicates(spark, monkeypatch):
    from gaugeloom.plans import evaluation

    asked = []
    for name in ("bootstrap_sums", "poisson_bootstrap_sums", "multinomial_bootstrap_sums"):
        real = getattr(statistics, name)
        monkeypatch.setattr(statistics, name, lambda *a, real=real, **k: asked.append(k["replicates"]) or real(*a, **k))
    for name in ("bootstrap_mean", "bootstrap_micro_f1", "bootstrap_poisson", "bootstrap_micro_f1_multinomial"):
        evaluation.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [1000] * 4


def test_welch_refuses_more_models_than_the_limit(spark):
    df = frame(spark, [(m, float(v)) for m in "abcd" for v in range(3)], "m string, v double")
    assert statistics.welch_tests(df, "m", "v", limit=4).count() == 6
    with pytest.raises(ValueError):
        statistics.welch_tests(df, "m", "v", limit=3)


def test_multinomial_bootstrap(spark):
    """Every replicate draws as many rows as there are; means, deviations and covariances are those of resampling; the same in any partitioning."""
    import numpy as np

    rng = random.Random(5)
    rows = [("a", rng.choice([-0.5, 0.0, 0.25, 1.0]), i % 3) for i in range(300)] + [("b", rng.gauss(0, 1), 1) for _ in range(70)] + [(None, None, 2)]
    df = frame(spark, rows, "g string, v double, k int")
    got = statistics.multinomial_bootstrap_sums(df, ["v", "k"], ["g"], replicates=2000).collect()
    assert len(got) == 6000 and len({(r.g, r.rep) for r in got}) == 6000
    for g, n in (("a", 300), ("b", 70), (None, 1)):
        mine = [r for r in got if r.g == g]
        assert all(r.n == n for r in mine)
        x = np.array([[v or 0.0, k] for h, v, k in rows if h == g])
        sums = np.array([[r.v, r.k] for r in mine])
        assert np.allclose(sums.mean(0), x.sum(0), atol=4 * np.sqrt(n * x.var(0).max() / 2000) + 1e-9)
        assert np.allclose(np.cov(sums.T, bias=True), n * np.cov(x.T, bias=True), atol=0.15 * n * max(x.var(0).max(), 1e-12))
    again = statistics.multinomial_bootstrap_sums(df.repartition(5), ["v", "k"], ["g"], replicates=2000).collect()
    key = lambda r: (str(r.g), r.rep)
    assert all(abs(a.v - b.v) < 1e-9 and a.n == b.n for a, b in zip(sorted(got, key=key), sorted(again, key=key)))
    assert statistics.multinomial_bootstrap_sums(df.limit(0), ["v"], replicates=3).count() == 0


def test_bootstrap_of_paired_deltas(spark):
    import numpy as np

    from gaugeloom.plans import evaluation

    rng = random.Random(5)
    deltas = {m: [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(n)] for m, n in (("a", 200), ("b", 70))}
    df = frame(spark, [(m, v) for m, vs in deltas.items() for v in vs], "model string, delta double")
    got = {r.model: r for r in evaluation.paired_interval(df).collect()}
    for m, vs in deltas.items():
        means = np.random.default_rng(1).choice(vs, (4000, len(vs))).mean(1)
        assert got[m].n == len(vs) and abs(got[m]["mean"] - np.mean(vs)) < 1e-8
        assert np.allclose((got[m]["std"], got[m].ci_lower, got[m].ci_upper), (means.std(ddof=1), *np.percentile(means, [2.5, 97.5])), atol=0.25 * means.std())
    assert "bootstrap_paired" in evaluation.QUERIES


def test_as_many_orders_as_asked_for(spark):
    """All 23 other orders of four options, 100 of six, and some of 18 and 25: distinct, none the given one."""
    for n, copies in ((4, 23), (6, 100), (18, 5), (25, 5)):
        df = frame(spark, [(f"i{k}", [f"o{j}" for j in range(n)]) for k in range(5)], "item string, opts array<string>")
        rows = sampling.permuted_copies(df, "item", "opts", copies, limit=8).collect()
        assert len(rows) == 5 * copies and len({(r.item, tuple(r.options)) for r in rows}) == 5 * copies
        given = [f"o{j}" for j in range(n)]
        assert all(sorted(r.options) == sorted(given) and r.options != given for r in rows)
    with pytest.raises(Exception, match="too few options"):
        sampling.permuted_copies(frame(spark, [("i", ["a", "b"])], "item string, opts array<string>"), "item", "opts", 2).collect()


def test_nothing_is_cut_from_reports_and_vocabularies(spark, tmp_path):
    from gaugeloom import charts
    from gaugeloom.sources import sinks

    df = spark.range(12).selectExpr("cast(id as string) as name", "cast(id as double) as v", "array(cast(id as string)) as labels")
    assert len(sampling.ranked_labels(df, "labels", limit=12)) == 12 and sampling.top_labels(df, "labels", 2) == ["0", "1"]
    assert reports.markdown(df.select("name", "v"), limit=12).count("\n") == 14 and len(charts.bar_rows(df, "name", "v", limit=12)) == 12
    for call in (
        lambda: sampling.ranked_labels(df, "labels", limit=11), lambda: reports.markdown(df.select("name"), limit=11), lambda: charts.bar_rows(df, "name", "v", limit=11),
        lambda: charts.heat_rows(df, "name", "name", "v", ["1"], limit=11), lambda: sinks.metrics_bundle(str(tmp_path / "m"), df, df, df, limit=11),
    ):
        with pytest.raises(ValueError):
            call()


def test_a_hot_key_is_spread(spark):
    """A third of the rows under one key: the joined rows lie in many partitions, and the results are those of a plain join."""
    from gaugeloom.runtime import heavy_keys, salted_lookup

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 1000 = 1 then null else concat('k', id % 5000) end as key", "id % 7 as exact")
        right = left.select("key").distinct().withColumn("v", F.length("key"))
        assert heavy_keys(left, "key", 8) == ["hot"]
        for nulls in (False, True):
            joined = salted_lookup(left, right, ["key"], "left", nulls_match=nulls)
            plain = left.join(right.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")) if nulls else F.col("key") == F.col("k"), "left").drop("k")
            assert sorted(map(str, joined.select("id", "key", "v").collect())) == sorted(map(str, plain.select("id", "key", "v").collect()))
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
        scored = left.selectExpr("id", "key as grp", "cast(exact = 0 as double) as exact", "0.0 as iou", "0.0 as partial", "cast(exact as string) as signature")
        rows = scoring.with_group(scored, ["grp"])
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert rows.count() == 30_000 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
