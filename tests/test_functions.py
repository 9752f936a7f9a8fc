import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom import dims
from gaugeloom.functions import keys as K
from gaugeloom.functions import labels as L
from gaugeloom.functions import text as X
from gaugeloom.operators import statistics

# A small alias table for the parser cases.
ALIASES = {
    "left": ["lhs", "on the left", "left side"], "right": ["rhs", "on the right", "right side"], "upper_arm": ["upper arm", "upper-arm", "above-elbow", "above elbow"], "forearm": ["forearm", "lower arm", "below-elbow", "below elbow"],
    "thigh": ["thigh", "upper leg", "proximal leg", "above-knee"], "calf": ["calf", "lower leg", "below-knee", "shin area"], "residual_limb": ["residual", "stump", "amputated arm", "amputated leg"],
    "prosthesis": ["prosthesis", "prosthetic device", "prosthetic arm"], "none_visible": ["none", "none visible", "not visible"],
}
FULL = list(ALIASES)
CASES = [
    ("lhs", FULL, ["left"], "ok"), ("on the right", FULL, ["right"], "ok"), ("above elbow", FULL, ["upper_arm"], "ok"), ("below-elbow", FULL, ["forearm"], "ok"), ("proximal leg", FULL, ["thigh"], "ok"), ("shin area", FULL, ["calf"], "ok"),
    ("amputated arm", FULL, ["residual_limb"], "ok"), ("prosthetic device", FULL, ["prosthesis"], "ok"), ("none visible", FULL, ["none_visible"], "ok"), ("right forearm prosthesis", FULL, ["right", "forearm", "prosthesis"], "ok"),
    ("below-knee prosthesis on the right", FULL, ["calf", "prosthesis", "right"], "ok"), ("amputated leg and left upper arm", FULL, ["residual_limb", "left", "upper_arm"], "ok"),
    ("left, prosthesis, calf", ["right", "prosthesis", "calf"], ["prosthesis", "calf"], "hallucinated"), ("unsure", FULL, [], "hallucinated"), ("   ", ["none_visible"], [], "unparsable"), (None, FULL, [], "unparsable"),
    ("ＬＥＦＴ  side;　calf", FULL, ["left", "calf"], "ok"), ("left left left", FULL, ["left"], "ok"),
]


def table():
    return X.AliasTable([(c, a) for c, aliases in ALIASES.items() for a in aliases])


def test_parser_cases(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, raw string, valid array<string>")
    p = table().parse(F.col("raw"), F.col("valid"))
    got = {r.i: r for r in df.select("i", *[v.alias(k) for k, v in p.items()]).collect()}
    for i, (raw, _, labels, status) in enumerate(CASES):
        assert (got[i].predicted_labels, got[i].parser_status) == (labels, status), raw
    assert got[12].unresolved_tokens == ["left"] and got[8].flags == ["none_visible_marker"] and got[14].flags == ["unparsable"]


def greedy(tokens, phrases):
    """A token loop that takes the longest phrase at each place."""
    labels, rest, buffer, i = [], [], [], 0
    while i < len(tokens):
        for p in sorted(phrases, key=lambda p: (-len(p.split()), -len(p), p)):
            w = p.split()
            if tokens[i : i + len(w)] == w:
                if buffer:
                    rest.append(" ".join(buffer))
                    buffer = []
                labels.append(phrases[p])
                i += len(w)
                break
        else:
            buffer.append(tokens[i])
            i += 1
    return labels, rest + ([" ".join(buffer)] if buffer else [])


def test_alternation_is_the_greedy_loop(spark):
    import random

    rng = random.Random(8)
    t = table()
    words = sorted({w for p in t.table for w in p.split()}) + ["foo", "bar"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", t.labels(F.col("t")).alias("l"), t.unresolved(F.col("t")).alias("u"))
    for r in df.collect():
        assert (r.l, r.u) == greedy(r.t.split(), t.table), r.t


def test_alias_versions():
    with pytest.raises(ValueError):
        X.AliasTable([("a", "b")], ["1.0"], "1.1")
    X.AliasTable([("a", "b")], ["1.1"], "1.1")


SETS = [([], []), ([], ["a"]), (["a"], []), (["a"], ["a"]), (["a", "b"], ["b", "c"]), (["a", "b", "c"], ["a"])]


def reference_metrics(g, p, empty):
    g, p = set(g), set(p)
    tp = len(g & p)
    pr = tp / len(p) if p else (empty if not g else 0.0)
    re = tp / len(g) if g else (empty if not p else 0.0)
    return {"exact": float(g == p), "partial": float(tp > 0 or not (g | p)), "precision": pr, "recall": re, "f1": 2 * pr * re / (pr + re) if pr + re else 0.0, "iou": tp / len(g | p) if g | p else 1.0, "tp": tp, "fp": len(p - g), "fn": len(g - p)}


@pytest.mark.parametrize("perfect", [True, False])
def test_set_metrics(spark, perfect):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(SETS)], "i int, g array<string>, p array<string>")
    m = L.set_metrics(F.col("g"), F.col("p"), perfect)
    for r in df.select("i", *[c.alias(k) for k, c in m.items()]).collect():
        want = reference_metrics(*SETS[r.i], 1.0 if perfect else 0.0)
        assert all(abs(r[k] - v) < 1e-12 for k, v in want.items()), r
    failed = L.set_metrics(F.col("g"), F.col("p"), True, F.lit(True))
    assert all(v == 0 for r in df.select(*[c.alias(k) for k, c in failed.items()]).collect() for v in r)


def test_properties_of_set_metrics(spark):
    import random

    rng = random.Random(0)
    rows = [([x for x in "abcde" if rng.random() < 0.4], [x for x in "abcde" if rng.random() < 0.4]) for _ in range(500)]
    df = spark.createDataFrame(rows, "g array<string>, p array<string>")
    a, b = L.set_metrics(F.col("g"), F.col("p")), L.set_metrics(F.col("p"), F.col("g"))
    ok = (a["iou"] >= 0) & (a["iou"] <= 1) & ((a["exact"] == 0) | (a["partial"] == 1)) & (a["f1"] <= F.greatest(a["precision"], a["recall"]) + 1e-12) & (a["f1"] == b["f1"]) & (a["precision"] == b["recall"]) & (a["iou"] == L.jaccard(F.col("g"), F.col("p")))
    assert df.where(~ok).count() == 0


def test_label_cleaning(spark):
    row = spark.createDataFrame([([" a ", None, "", "None", "b"], "x, ,none,y", None)], "l array<string>, s string, n array<string>").select(
        L.clean_labels(F.col("l")).alias("a"), L.split_labels(F.col("s")).alias("b"), L.clean_labels(F.col("n")).alias("c"), L.clean_choices(F.col("n"), F.array(F.lit(" b"), F.lit("A"), F.lit("a"))).alias("d"),
        L.clean_choices(F.col("n"), F.col("n"), F.lit("c")).alias("e"), L.first_filled(F.col("n"), F.array().cast("array<string>"), F.col("l")).alias("f"), L.option_letters(F.lit(3)).alias("g"), L.option_letters(F.lit(0)).alias("h"),
    ).first()
    assert row.a == ["a", "b"] and row.b == ["x", "none", "y"] and row.c == [] and row.d == ["A", "B"] and row.e == ["C"] and row.f[0] == " a " and row.g == ["A", "B", "C"] and row.h == []


def test_cues(spark):
    cases = [(["calf_l_residual", "CALF_R_prosthesis"], ["calf", "left", "prosthesis", "residual_limb", "right"]), (["none"], ["none_visible"]), ([], ["none_visible"]), (None, ["none_visible"]), (["odd"], []), (["none", "thigh_l_residual"], ["left", "residual_limb", "thigh"])]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, l array<string>")
    assert {r.i: r.c for r in df.select("i", L.composite_to_cues(F.col("l")).alias("c")).collect()} == {i: c[1] for i, c in enumerate(cases)}


CHOICES = [
    ('{"choices": ["A", "c", "A"]}', ["A", "C"], 0), ('```json\n{"choices": []}\n```', [], 0), ('{"choice": "b"}', ["B"], 0), ('text "choices": ["A", "B"', ["A", "B"], 0), ('x "choices" : ["D","H"] y', ["D", "H"], 0), ("'choice': 'e'", ["E"], 0),
    ("I take C and A.", ["A", "C"], 0), ("nothing here", [], 1), ("", [], 1), (None, [], 1), ('{"choices": "A"}', ["A"], 0), ('{"choices": ["Z"]}', [], 0), ("{bad} B", ["B"], 0),
]


def test_choices(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CHOICES)], "i int, raw string")
    for r in X.with_choices(df, "raw", "c", "e").collect():
        assert (r.c, r.e) == CHOICES[r.i][1:], CHOICES[r.i]
    rows = X.with_choices(spark.createDataFrame([("1, 3",), ('{"choices": ["2", "9"]}',), ("none",)], "raw string"), "raw", "c", "e", numeric=True).collect()
    assert [(r.c, r.e) for r in rows] == [(["A", "C"], 0), (["B"], 0), ([], 1)]


def test_presence_answers(spark):
    df = spark.createDataFrame([('{"answer": "C"}',), ("It is b, not a.",), ("a or b",), ("xyz",), (None,)], "raw string")
    rows = df.select(X.presence_by_position(F.col("raw")).alias("p"), X.presence_by_letter(F.lit(None).cast("string"), F.col("raw")).alias("l")).collect()
    assert [(r.p, r.l) for r in rows] == [("c", "c"), ("b", "a"), ("a", "a"), (None, None), (None, None)]


def test_segments(spark):
    df = spark.createDataFrame([('{"labels": ["x", "thigh", "x"]}',), ('"thigh", calf, other',), ("",)], "raw string")
    assert [r[0] for r in df.select(X.segment_labels(F.col("raw"), ["thigh", "calf"])).collect()] == [["x", "thigh"], ["thigh", "calf"], []]


def test_category_names(spark):
    names = {"left-upper-arm-articulated-pro": "upper_arm_l_prosthesis", "Right-Fore-Arm-residual": "forearm_r_residual", "right-forearm-residual": "forearm_r_residual", "left-calf": None, "person": None, "left-thigh-other-pro": None, "calf-residual": None, "": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.evidence_label(F.col("n")).alias("l"))
    assert {r.n: r.l for r in df.collect()} == names


def test_strings(spark):
    row = spark.range(1).select(
        X.file_safe(F.lit('a/b\\c: d*e?f"g<h>i|j')).alias("a"), X.base_record(F.lit("r1::shuffle2")).alias("b"), X.cell(F.lit(1234.5)).alias("c"), X.cell(F.lit(None).cast("double")).alias("d"), X.duration(F.lit(3725)).alias("e"),
        X.duration(F.lit(65)).alias("f"), X.without_json_sentences(F.lit("Pick one. Return JSON only. Thanks!")).alias("g"), X.nfkc(F.lit("ﬁ①")).alias("h"), X.strip_punctuation(F.lit("a. b , c;d_e-f/g!")).alias("i"),
    ).first()
    assert row.a == "a_b_c__d_e_f_g_h_i_j" and row.b == "r1" and row.c == "1234.500" and row.d == "NA" and row.e == "1h 2m 5s" and row.f == "1m 5s" and row.g == "Pick one. Thanks!" and row.h == "fi1" and row.i == "a b,c;d e-f/g"


def test_keys(spark):
    row = spark.range(1).select(
        K.task(F.lit(" Presence")).alias("a"), K.option_record(F.lit(" "), F.lit("r")).alias("b"), K.group_join_key(F.lit("presence_img12"), F.lit(None).cast("bigint")).alias("c"), K.group_join_key(F.lit("g"), F.lit(None).cast("bigint")).alias("d"),
        K.record_prefix(F.lit(""), F.lit("g"), F.lit(3)).alias("e"), K.variant(F.lit(" A-b ")).alias("f"), K.truth(F.lit("Yes")).alias("g"), K.truth(F.lit("?"), True).alias("h"), K.answer_space(F.lit(None).cast("string"), F.lit(4), F.array()).alias("i"), K.base_name(F.lit("a/b/c.png")).alias("j"),
    ).first()
    assert tuple(row) == ("recognition", "r", "12", "g", "g::prompt3", "a_b", True, True, "constrained", "c.png")
    with pytest.raises(Exception):
        spark.range(1).select(K.record_prefix(F.lit(""), F.lit(""), F.lit(None).cast("int"))).collect()


def test_parts():
    assert dims.coarse_of("left_arm_upper") == "arm_upper" and dims.hard_negatives("arm_upper") == ["arm_lower"] and dims.cross_limb("arm_upper") == ["leg_upper", "leg_lower"]
    assert len(dims.evidence_vocabulary()) == 16 and dims.evidence_vocabulary(True)[-1] == "none" and dims.evidence_vocabulary()[8].endswith("prosthesis")
    with pytest.raises(ValueError):
        dims.coarse_of("tail")


@settings(max_examples=40, deadline=None)
@given(st.floats(0.1, 30), st.integers(1, 200))
def test_student_t(t, df):
    # The density integrates to the tail that the incomplete beta function states.
    import math

    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n = 20_000
    h = t / n
    body = sum((1 if i in (0, n) else 4 if i % 2 else 2) * c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)) * h / 3
    assert abs(statistics.t_two_sided(t, df) - (1 - 2 * body)) < 1e-7


def test_student_quantiles():
    for df, want in ((1, 12.7062), (4, 2.7764), (30, 2.0423), (1000, 1.9623)):
        assert abs(statistics.t_quantile(0.975, df) - want) < 1e-3 and abs(statistics.t_quantile(0.025, df) + want) < 1e-3
