import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from gaugeloom.operators import messages
from gaugeloom.runtime import heavy_keys, instant_micros, salted_join

SCHEMA = "delivery_id bigint, item_id string, model_id string, timestamp string, raw_text string"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_instants(spark):
    cases = {
        "2026-01-01T00:00:00Z": 0, "2026-01-01 00:00:00": 0, "2026-01-01T01:00:00+01:00": 0, "2026-01-01T01:00:00+0100": 0, "2025-12-31T19:00:00-05:00": 0,
        "2026-01-01": 0, " 2026-01-01t00:00:00.5z ": 500_000, "nonsense": None, "": None, None: None, "2026-13-45T00:00:00": None,
    }
    base = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1e6)
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", instant_micros(F.col("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == {k: None if v is None else base + v for k, v in cases.items()}


def test_instants_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([("1970-01-01T00:00:01",)], "t string").select(instant_micros(F.col("t"))).first()
        assert row[0] == 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_edges(spark):
    rows = [
        (5, "A:1", "m", "2026-01-01T00:00:00", "x"), (3, " a:1\t", "M ", "2026-01-01 01:00:00+01:00", "x"), (9, "a:1", "m", "2026-01-01T00:00:00.000000Z", None),
        (1, None, "m", "2026-01-01T00:00:00", "x"), (2, None, "m", "2026-01-01T00:00:00", "x"), (4, "a:1", None, "2026-01-01T00:00:00", "x"), (6, "a:1", "m", None, "x"), (7, "a:1", "m", "never", "x"), (8, "a:1", "m", "never", "x"),
        (10, "", "", "2026-01-01", ""), (11, "", "", "2026-01-01", ""), (12, "long" * 50_000, "m", "2026-01-01", "x" * 200_000), (13, "LONG" * 50_000, "m", "2026-01-01", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(messages.repeated_deliveries(df)) == [5, 9, 11, 13]
    assert ids(messages.repeated_deliveries(df.union(df))) == [5, 9, 11, 13]
    assert ids(messages.repeated_deliveries(df.limit(0))) == []
    clash = df.withColumn("_item", F.lit("z")).withColumn("keep", F.lit(1)).withColumn("_at", F.lit(2))
    assert ids(messages.repeated_deliveries(clash)) == [5, 9, 11, 13]
    kept = messages.first_deliveries(clash)
    assert ids(kept.select("delivery_id")) == [1, 2, 3, 4, 6, 7, 8, 10, 12] and kept.columns == clash.columns


def test_batches_collapse_in_compaction_and_upserts_are_idempotent(spark):
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    rows = [(i, f"i:{rng.randrange(30)}" if i % 3 else "i:0", "m", (start + timedelta(seconds=rng.randrange(3))).isoformat(), "t") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    first = {}
    for i, item, model, at, _ in sorted(rows):
        first.setdefault((item, model, at), i)
    want = sorted(set(range(900)) - set(first.values()))
    assert ids(messages.repeated_deliveries(df)) == want
    parts = [spark.createDataFrame(rows[k::3], SCHEMA) for k in range(3)]
    assert ids(messages.repeated_deliveries(df, batches=[*parts, parts[0]])) == want

    store = messages.MessageStore(spark, ["item_id", "model_id", "timestamp"], "delivery_id", buckets=4)
    for p in [*parts, parts[1]]:
        store.upsert(p)
    assert store.compact().count() == len(first)
    plan = store.compact()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # buckets are merged in place


def test_heavy_keys_are_salted_and_nothing_is_lost(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "key string, v int")
    assert heavy_keys(left, "key", 8) == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(left, right, "key", ["id"], how)
        b = left.join(right, "key", how)
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=str)
