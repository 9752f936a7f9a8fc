import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom.functions.treedit import assign, edit_script
from gaugeloom.operators import drift

SCHEMA = "raw_id bigint, stream_id bigint, file_id bigint, file_no int, record_kind string, line_no int, received_at timestamp, payload string"


def raw(spark, files, kind="items", stream=1):
    rows, n = [], 0
    for no, lines in enumerate(files, 1):
        for k, line in enumerate(lines, 1):
            n += 1
            rows.append((n, stream, stream * 100 + no, no, kind, k, None, line if line is None or isinstance(line, str) else json.dumps(line)))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted((r.file_id, r.change, r.old_field, r.new_field) for r in drift.file_changes(df).collect())


def test_added_removed_renamed_retyped(spark):
    a = [{"item_id": "x:1", "meta": {"a": 1, "b": [{"c": "u", "n": 2}], "t": "s", "o": 5}}, {"item_id": "x:2", "meta": {"a": 2, "b": [{"c": "v"}], "t": "q", "o": 6}}]
    b = [{"item_id": "x:2", "meta": {"z": 2, "b": [{"d": "v"}], "t": 1.0, "p": 9}}, {"item_id": "x:3", "meta": {"z": 7, "b": [{"d": "w", "n": 4}], "t": 2.5, "p": 1}}]
    assert changes(raw(spark, [a, b])) == [(102, "added", "", "meta.p"), (102, "removed", "meta.o", ""), (102, "renamed", "meta.a", "meta.z"), (102, "renamed", "meta.b[].c", "meta.b[].d"), (102, "retyped", "meta.t", "meta.t")]


def test_edges(spark):
    a = [{"item_id": "x:1", "m": {"a": 1, "gone": True, "e": []}}]
    df = raw(spark, [a, ["{broken", None, "3", "[1]", ""], a])
    assert changes(df) == [(102, "removed", "item_id", ""), (102, "removed", "m.a", ""), (102, "removed", "m.e", ""), (102, "removed", "m.gone", ""), (103, "added", "", "item_id"), (103, "added", "", "m.a"), (103, "added", "", "m.e"), (103, "added", "", "m.gone")]
    assert changes(df.where("file_no <> 2")) == []  # a gap: no preceding file
    assert changes(df.limit(0)) == []
    same = raw(spark, [a, a + a, [{"item_id": "x:1", "m": {"a": None, "gone": True, "e": ["k"]}, "long": "y" * 300_000}]])
    assert changes(same.withColumn("leaves", F.lit(1)).withColumn("rec", F.lit("r"))) == [(103, "added", "", "long"), (103, "removed", "m.a", "")]
    objects = raw(spark, [[{"item_id": "1", "b": [{"c": 1}]}, {"item_id": "2", "b": []}], [{"item_id": "1", "b": [{"c": 1}]}]])
    assert changes(objects) == []


def test_no_shared_records_means_no_renaming(spark):
    df = raw(spark, [[{"item_id": "1", "a": 1}], [{"item_id": "2", "b": 1}]])
    assert changes(df) == [(102, "added", "", "b"), (102, "removed", "a", "")]
    unequal = raw(spark, [[{"item_id": "1", "a": 1}], [{"item_id": "1", "b": 2}]])
    assert changes(unequal) == [(102, "added", "", "b"), (102, "removed", "a", "")]


def test_predictions_are_matched_by_all_key_parts(spark):
    one = {"item_id": "1", "model_id": "m", "timestamp": "t"}
    df = raw(spark, [[{**one, "choices": ["A"]}, {**one, "timestamp": "u", "choices": ["B"]}], [{**one, "picked": ["A"]}]], "predictions")
    assert changes(df) == [(102, "renamed", "choices", "picked")]


def test_consistent_table(spark):
    a = [{"item_id": "1", "meta": {"seed": 1, "src": "s"}}]
    b = [{"item_id": "1", "meta": {"rng": 1, "src": "s"}}, {"item_id": "2", "meta": {"rng": 2, "src": "q"}}]
    c = [{"item_id": "2", "meta": {"rng": 2.5, "src": "q"}}, "{bad"]
    rows = drift.consistent_table(raw(spark, [a, b, c]), "items").orderBy("file_no", "line_no").collect()
    assert [(r.item_id, r.meta_seed, r.meta_src) for r in rows] == [("1", 1.0, "s"), ("1", 1.0, "s"), ("2", 2.0, "q"), ("2", 2.5, "q")]
    few = drift.consistent_table(raw(spark, [a, b, c]), "items", max_columns=1)
    assert sum(len(r.extra) for r in few.collect()) == 8  # nothing is lost
    assert drift.consistent_table(raw(spark, [a, b, c]), "predictions").count() == 0


fields = st.dictionaries(st.sampled_from(["a", "b", "m.a", "m.b", "m.c", "n.x", "n.y[].z"]), st.sampled_from(["string", "whole"]), max_size=6)


@settings(max_examples=150, deadline=None)
@given(fields, fields, st.sets(st.tuples(st.sampled_from(["a", "b", "m.a", "m.b"]), st.sampled_from(["m.c", "n.x", "b", "a"]))))
def test_script_turns_old_into_new(old, new, same):
    steps = edit_script(old, new, lambda p, q: (p, q) in same)
    have = dict(old)
    for change, p, q in steps:
        if change in ("removed", "renamed"):
            kind = have.pop(p)
            if change == "renamed":
                assert (p, q) in same and p not in new and q not in old and kind == new[q]
    for change, p, q in steps:
        if change == "retyped":
            assert old[p] != new[q]
    renamed = {q: old[p] for c, p, q in steps if c == "renamed"}
    added = {q for c, _, q in steps if c == "added"}
    assert set(have) | set(renamed) | added == set(new)
    # No step is wasted: as many renamings as any pairing of gone and new fields allows.
    gone, fresh = [p for p in old if p not in new], [q for q in new if q not in old]
    best, stack = 0, [(0, frozenset())]
    while stack:
        i, used = stack.pop()
        best = max(best, len(used))
        if i < len(gone):
            stack.append((i + 1, used))
            stack += [(i + 1, used | {q}) for q in fresh if q not in used and (gone[i], q) in same and old[gone[i]] == new[q]]
    assert len(renamed) == best


def test_assignment_is_least_cost():
    from itertools import permutations

    rng = random.Random(1)
    for n in range(1, 6):
        for _ in range(20):
            cost = [[rng.randrange(9) for _ in range(n)] for _ in range(n)]
            got = sum(cost[i][j] for i, j in enumerate(assign(cost)))
            assert got == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
