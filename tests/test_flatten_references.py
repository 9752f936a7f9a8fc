import datetime as dt
import random

from pyspark.sql import functions as F

from gaugeloom.operators import flatten, references

ITEM = (
    "item_row bigint, item_id string, person_image struct<image_id:string,focus:struct<mode:string,bbox_xyxy:array<double>>>, options array<struct<option_id:string,pos:string,in:struct<a:int,l:array<int>>>>, "
    "answer struct<correct_option_ids:array<string>,target_coarse_parts:array<string>,target_part8s:array<string>>, extra string, pos int"
)


def items(spark):
    focus = ("crop", [1.0])
    rows = [
        (1, "i1", ("5", focus), [("A", "p", (1, [1, 2])), None, ("C", None, None)], (["A", None, "B"], [], None), "x" * 100_000, 7),
        (2, "i2", ("5", None), [], None, None, None),
        (3, None, None, None, (None, ["q", "q"], [None]), "", 0),
        (3, None, None, None, (None, ["q", "q"], [None]), "", 0),
        (4, "i4", (None, (None, None)), None, ([], [], []), None, None),
    ]
    return spark.createDataFrame(rows, ITEM)


def test_children(spark):
    got = sorted((r.item_row, r.child, r.pos) for r in flatten.item_children(items(spark)).collect())
    want = [(1, "answer.correct_option_ids", 0), (1, "answer.correct_option_ids", 2), (1, "options", 0), (1, "options", 2), (1, "person_image.focus", 0)]
    want += [(3, "answer.target_coarse_parts", p) for p in (0, 0, 1, 1)] + [(4, "person_image.focus", 0)]
    assert got == sorted(want)
    assert flatten.item_children(items(spark).limit(0)).count() == 0


def test_child_tables_keep_keys_and_fields(spark):
    rows = flatten.child_table(items(spark), "item_row", "options").orderBy("item_row", "pos").collect()
    assert [(r.item_row, r.pos, r.option_id, r.pos_, r.in_a) for r in rows] == [(1, 0, "A", "p", 1), (1, 2, "C", None, None)]
    plain = flatten.child_table(items(spark), "item_row", "answer.correct_option_ids").collect()
    assert sorted((r.item_row, r.pos, r.value) for r in plain) == [(1, 0, "A"), (1, 2, "B")]
    focus = flatten.child_table(items(spark), "item_row", "person_image.focus").collect()
    assert sorted((r.item_row, r.pos, str(r.mode)) for r in focus) == [(1, 0, "crop"), (4, 0, "None")]
    parent = flatten.parent_table(items(spark), "item_row")
    assert parent.columns == ["item_row", "item_id", "person_image_image_id", "person_image_focus_mode", "extra", "pos"] and parent.count() == 5


def test_null_struct_with_hidden_children_has_none(spark):
    df = spark.sql("select id as k, if(id % 2 = 0, named_struct('l', array(1, 2)), null) as s from range(6)")
    assert flatten.child_positions(df, "k", ["s.l"]).count() == 6


def test_long_and_many_lists_agree_with_posexplode(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(1), (F.col("id") % 50 + 1).cast("int")), lambda i: F.when(i % 3 > 0, i))).alias("l")).repartition(3)
    a = flatten.child_positions(df, "id", ["l"]).select("id", "pos")
    b = df.select("id", F.posexplode("l").alias("pos", "v")).where("v is not null").select("id", "pos")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


T0 = dt.datetime(2026, 3, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


PRED, BENCH = "delivery_id bigint, item_id string, delivered_at timestamp, loaded_at timestamp, _key string", "item_row bigint, item_id string, loaded_at timestamp, deleted_at timestamp, delivered_at timestamp"


def test_presence_interval(spark):
    bench = spark.createDataFrame([(1, "a:1", day(2), None, T0), (2, "a:1", day(0), None, T0), (3, "b:1", day(0), day(5), T0), (4, None, day(0), None, T0), (5, "c:1", None, None, T0)], BENCH)
    rows = [
        (1, " A:1", day(0), T0, "z"), (2, "a:1", day(0) - dt.timedelta(seconds=1), T0, "z"), (3, "b:1", day(5), T0, "z"), (4, "b:1", day(5) - dt.timedelta(microseconds=1), T0, "z"),
        (5, "nope", day(40), T0, "z"), (6, None, day(1), T0, "z"), (7, "", day(1), T0, "z"), (8, "c:1", day(-9), T0, "z"), (9, "x" * 100_000, day(1), T0, "z"), (5, "nope", day(40), T0, "z"),
    ]
    pred = spark.createDataFrame(rows, PRED)
    got = sorted((r.delivery_id, r.period) for r in references.orphan_references(pred, bench).collect())
    assert got == [(2, "2026-02"), (3, "2026-03"), (5, "2026-04"), (5, "2026-04"), (7, "2026-03"), (9, "2026-03")]
    assert references.orphan_references(pred, bench.limit(0)).count() == 9
    assert references.orphan_references(pred.limit(0), bench).count() == 0
    report = {r.period: r.n_orphans for r in references.orphan_report(pred, bench).collect()}
    assert report == {"2026-02": 1, "2026-03": 3, "2026-04": 2}


def test_bloom_filter_has_no_false_negatives_and_stays_small(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    probe = spark.range(8000).select("id", F.concat(F.lit("k"), "id").alias("k"))
    for limit in (16 << 20, 4096):
        bloom = references.bloom_filter(keys, "k", limit)
        assert bloom[0].count() * references.WORDS * 8 <= max(limit, 4096)
        hit = references.with_bloom_hit(probe, "k", bloom)
        assert hit.where("id < 4000 and not _hit").count() == 0
        if limit > 4096:
            assert hit.where("id >= 4000 and _hit").count() < 400


def test_skewed_references_agree_with_brute_force(spark):
    rng = random.Random(5)
    bench = [(i, f"i:{i}", day(rng.randrange(10)), day(20 + rng.randrange(10)) if i % 4 == 0 else None, T0) for i in range(60)]
    pred = [(i, "i:0" if i % 3 == 0 else f"i:{rng.randrange(90)}", day(rng.randrange(40)), T0, "") for i in range(3000)]
    span = {r[1]: (r[2], r[3]) for r in bench}
    want = sorted(i for i, k, t, _, _ in pred if k not in span or t < span[k][0] or (span[k][1] and t >= span[k][1]))
    got = references.orphan_references(spark.createDataFrame(pred, PRED), spark.createDataFrame(bench, BENCH))
    assert sorted(r.delivery_id for r in got.collect()) == want


def test_lists_within_lists_keep_their_links(spark):
    """Every list at any depth is a table; its outer places are the key and place of its parent row."""
    schema = "k int, a struct<rows:array<struct<n:string,pos:int,cells:array<array<int>>,tags:array<string>>>>, plain string"
    data = [
        (1, ([("x", 7, [[1, 2], None, [], [3, None]], ["t", None]), None, ("y", None, None, [])],), "p"), (2, (None,), "q"), (3, None, None), (4, ([],), ""), (1, ([("x", 7, [[1, 2]], ["t"])],), "again"),
    ]
    df = spark.createDataFrame(data, schema)
    tables = flatten.related_tables(df, "k")
    assert list(tables) == ["", "a.rows", "a.rows.cells", "a.rows.tags"]
    got = lambda p: sorted(map(tuple, tables[p].collect()), key=str)
    rows = [(k, i, r[0], r[1]) for k, a, _ in data if a and a[0] for i, r in enumerate(a[0]) if r]
    assert got("a.rows") == sorted(rows, key=str) and tables["a.rows"].columns == ["k", "pos", "n", "pos_"]
    cells = [(k, i, j, m, v) for k, a, _ in data if a and a[0] for i, r in enumerate(a[0]) if r and r[2] for j, c in enumerate(r[2]) if c for m, v in enumerate(c) if v is not None]
    assert got("a.rows.cells") == sorted(cells, key=str) and tables["a.rows.cells"].columns == ["k", "rows_pos", "cells_pos", "pos", "value"]
    tags = [(k, i, j, v) for k, a, _ in data if a and a[0] for i, r in enumerate(a[0]) if r and r[3] for j, v in enumerate(r[3]) if v is not None]
    assert got("a.rows.tags") == sorted(tags, key=str)
    parents = {(r.k, r.pos) for r in tables["a.rows"].collect()}
    assert {(r.k, r.rows_pos) for r in tables["a.rows.tags"].collect()} <= parents
    assert tables[""].count() == 5 and flatten.child_table(df.limit(0), "k", "a.rows.cells").count() == 0
