import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeloom import charts, images, inference, schemas
from gaugeloom.sources import readers, sinks
from gaugeloom.streaming import incremental


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_json_lines(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"item_id": "1", "choice": "A"}, "", {"item_id": "2", "choices": ["B"], "unknown": 1}])
    df = readers.json_lines(spark, str(tmp_path / "a.jsonl"), schemas.PREDICTION)
    assert sorted((r.item_id, r.choice, r.choices) for r in df.collect()) == [("1", "A", None), ("2", None, ["B"])]
    assert readers.count_lines(spark, str(tmp_path / "a.jsonl")) == 2 and readers.count_lines(spark, str(tmp_path / "no.jsonl")) == 0
    assert readers.read_or_empty(spark, str(tmp_path / "no.jsonl"), schemas.PREDICTION).count() == 0
    write(tmp_path / "bad.jsonl", ["{broken", {"item_id": "3"}])
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.PREDICTION).collect()
    assert [r.item_id for r in readers.json_lines(spark, str(tmp_path / "bad.jsonl"), schemas.PREDICTION, strict=False).collect()] == ["3"]


def test_last_record_of_a_key_wins(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"item_id": "1", "raw_text": "old"}, {"item_id": "1", "raw_text": "new"}, {"item_id": " "}])
    df = readers.with_origin(readers.json_lines(spark, str(tmp_path / "a.jsonl"), schemas.PREDICTION))
    assert [(r.item_id, r.raw_text) for r in readers.keyed(df, "item_id").collect()] == [("1", "new")]
    with pytest.raises(Exception):
        readers.keyed(df, "item_id", required=True).collect()


def test_discovery_and_models(spark, tmp_path):
    write(tmp_path / "m1_20260101" / "predictions.jsonl", [{"item_id": "1"}])
    write(tmp_path / "m2" / "predictions.jsonl", [{"item_id": "1", "model_id": "named"}, {"item_id": "2"}])
    write(tmp_path / "m2" / "other.jsonl", [{"item_id": "9"}])
    assert [f.split("/")[-2] for f in readers.discover(str(tmp_path))] == ["m1_20260101", "m2"]
    assert len(readers.discover(str(tmp_path / "m2" / "other.jsonl"))) == 1
    got = sorted((r.item_id, r.model) for r in readers.predictions_by_model(spark, str(tmp_path)).collect())
    assert got == [("1", "m1"), ("1", "named"), ("2", "named")]


def test_metric_files_and_sinks(spark, tmp_path):
    for n, v in (("a", 1.0), ("b", 2.0)):
        sinks.document({"variant": "v", "model_name": "m", "metrics": {"x": v}}, str(tmp_path / n / "r.metrics.json"))
    assert [r.metrics["x"] for r in readers.metric_files(spark, str(tmp_path)).collect()] == [2.0]
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "i int, s string, tp int, fp int, fn int")
    sinks.csv(df, str(tmp_path / "csv"), ["s", "i"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["s", "i"]
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.metrics_bundle(str(tmp_path / "bundle"), df.select("i"), df, df.select("s"))
    assert set(spark.read.json(str(tmp_path / "bundle.items")).columns) == {"i", "s"} and json.loads((tmp_path / "bundle.metrics.json").read_text())["metrics"] == [{"i": 1}]


def test_alias_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("policy_version: 1.1\naliases:\n  left: [lhs, on the left]\n  none:\n")
    assert sorted(r.alias for r in readers.alias_table(spark, str(tmp_path / "a.yaml"), "1.1").collect()) == ["lhs", "on the left"]
    with pytest.raises(ValueError):
        readers.alias_table(spark, str(tmp_path / "a.yaml"), "2.0")
    (tmp_path / "p.md").write_text("# x\npolicy_version: 1.1.0\n")
    assert readers.policy_version(str(tmp_path / "p.md")) == "1.1.0"


def test_stream_takes_each_item_once_across_restarts(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "event_id bigint, event_type string"

    def run():
        stream = incremental.once(incremental.stream_records(spark, src, schema), ["event_id"])
        incremental.append_to(stream, out, check).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], schema).write.mode("append").parquet(src)
    assert run() == [1, 2]
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.mode("append").parquet(src)
    assert run() == [1, 2, 3] and run() == [1, 2, 3]
    counts = incremental.stream_records(spark, src, schema).groupBy("event_type").count()
    incremental.snapshot_to(counts, str(tmp_path / "snap"), str(tmp_path / "check2")).awaitTermination()
    assert {r.event_type: r["count"] for r in spark.read.parquet(str(tmp_path / "snap")).collect()} == {"a": 2, "b": 2, "c": 1}


def test_resume_and_cache(spark):
    items = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    done = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.k for r in incremental.resume(items, done, "k").collect()] == ["b"]
    results = spark.createDataFrame([("a", True), ("b", False)], "k string, success boolean")
    assert {r.k: r.status for r in incremental.cached_or_open(items, results, ["k"]).collect()} == {"a": "cached", None: "open", "b": "open"}


def test_smoothed_rate(spark):
    df = spark.createDataFrame([("x", 0, 0.0, 5), ("x", 1, 2.0, 10), ("x", 2, 3.0, 10)], "k string, o int, t double, n int")
    assert abs(incremental.smoothed_rate(df, "k", "t", "o", 0.5).first().rate - (0.5 * 10 + 0.5 * 5)) < 1e-12


def test_model_calls(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(10)], "id bigint, prompt string").coalesce(1)

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    rows = inference.call_model(df, model, inference.RunConfig("m", batch=4, retries=0), "id", "prompt").collect()
    assert [r.raw_text for r in rows if r.success] == [f"P{i}" for i in range(10) if i != 3] and [r.error for r in rows if not r.success] == ["no"] and [r.id for r in rows] == list(range(10))
    rec = inference.recorded(df, spark.createDataFrame([(1, "x"), (1, "x")], "id bigint, raw_text string"), ["id"])
    assert rec.count() == 10 and rec.where("success").count() == 1
    with pytest.raises(ValueError):
        inference.RunConfig("", batch=0)
    assert inference.stages(None, None) == (True, True) and inference.stages(True, None) == (True, False) and inference.stages(None, False) == (True, False) and inference.stages(None, False, False) == (False, False)
    assert inference.choices_schema(["A"], 1)["properties"]["choices"]["maxItems"] == 1


def test_images(spark):
    mask = images.polygon_mask([[1, 1, 4, 1, 4, 3, 1, 3]], 6, 5)
    assert mask.sum() == 6 and mask[1:3, 1:4].all() and images.polygon_mask([[1, 1]], 3, 3).sum() == 0
    img = np.arange(60, dtype=np.uint8).reshape(5, 12)
    assert images.letterbox(img, 24).shape == (24, 24) and images.longest_side(img, 6).shape == (2, 6) and images.longest_side(img, 99) is img
    assert images.crop_instance(img, [3, 1, 6, 3], None, 0, 6).shape == (6, 6) and images.crop_instance(img, [99, 0, 100, 1]) is None
    assert images.option_grid([img, img, img], 2, 10, 1).shape == (23, 23) and images.side_by_side(img, img).shape == (5, 24)
    assert len(images.pixel_hash(img)) == 16
    df = spark.createDataFrame([("a", bytearray(b"\x01\x02\x03\x04"))], "path string, content binary")
    row = df.select(images.data_url(F.col("content")).alias("u"), images.content_hash(F.col("content")).alias("h")).first()
    assert row.u.startswith("data:image/png;base64,AQID") and len(row.h) == 16
    out = images.map_images(df, lambda a: a * 2, lambda b: np.frombuffer(b, np.uint8).reshape(2, 2)).first()
    assert (out.height, out.width, bytes(out.pixels)) == (2, 2, b"\x02\x04\x06\x08")


def test_chart_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("b", "y", None)], "m string, v string, s double")
    assert [r[0] for r in charts.bar_rows(df, "m", "s")] == ["b", "a"]
    names, cells = charts.heat_rows(df, "m", "v", "s", ["x", "y"])
    assert names == ["a", "b"] and cells[1][0] == 3.0 and np.isnan(cells[0][1])


def test_display_and_small_readers(spark, tmp_path):
    from gaugeloom.functions import display as D

    row = spark.range(1).select(
        D.rate(F.lit(2.0)).alias("a"), D.rate(F.lit(0.5)).alias("b"), D.days_hours_minutes(F.lit(93784)).alias("c"), D.remaining(F.lit(10.0), F.lit(5), F.lit(15)).alias("d"), D.remaining(F.lit(10.0), F.lit(0), F.lit(15)).alias("e"),
        D.image_path("/p/img", "/p", F.lit("x.png")).alias("f"), D.model_size(F.lit("lumen-vl-30b-instruct")).alias("g"), D.model_title(F.lit("lumen-vl-4b")).alias("h"), D.variant_of_path(F.lit("compatibility_category.jsonl")).alias("i"),
    ).first()
    assert tuple(row) == ("2.00 it/s", "30.00 it/min", "1d 2h 3m", 20.0, None, "img/x.png", 30.0, "Lumen Vl 4B", "compatibility_category")
    names = ["b-4b", "a-12b", "a-4b-thinking", "a-4b-instruct", "a-4b", "z"]
    assert [r.m for r in D.ordered_models(spark.createDataFrame([(n,) for n in names], "m string"), "m", ["a", "b"]).collect()] == ["a-4b", "a-4b-instruct", "a-4b-thinking", "a-12b", "b-4b", "z"]
    sinks.document({"p": ["one"], "confusion": {"a": {"a": 1, "b": 0}, "d": {"a": 0}}}, str(tmp_path / "x.json"))
    assert readers.prompts(str(tmp_path / "x.json"), "p") == ["one"]
    with pytest.raises(ValueError):
        readers.prompts(str(tmp_path / "x.json"), "q")
    assert readers.confusion_cells(spark, str(tmp_path / "x.json"), ["d"]).count() == 2


def test_small_files_on_any_file_system(spark, tmp_path):
    """Texts go through the session's file systems, so a scheme is no obstacle; writing again replaces, mirrors copy."""
    from gaugeloom.runtime import exists, read_text
    from gaugeloom.sources import readers, sinks

    at = (tmp_path / "deep" / "doc.json").as_uri()
    assert not exists(at)
    for payload in ({"a": "é 日本"}, {"a": [1, None]}):
        sinks.document(payload, at)
        assert json.loads(read_text(at)) == payload
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["doc.json"]
    sinks.mirror(at, (tmp_path / "copy.json").as_uri())
    assert json.loads((tmp_path / "copy.json").read_text()) == {"a": [1, None]}
    sinks.text(str(tmp_path / "t.md"), "# x")
    assert read_text(str(tmp_path / "t.md")) == "# x"
    (tmp_path / "good.metrics.json").write_text('{"overall": {"a": 1}}')
    (tmp_path / "bad.metrics.json").write_text('{"overall": ')
    assert [r.path.rsplit("/", 1)[1] for r in readers.unreadable_files(spark, str(tmp_path)).collect()] == ["bad.metrics.json"]
    assert readers.from_template("runs/{model}/predictions.jsonl", model="m") == "runs/m/predictions.jsonl"
    with pytest.raises(KeyError):
        readers.from_template("{model}")
    df = readers.cached(spark.range(3))
    assert df.count() == 3 and df.storageLevel.useMemory
    readers.drop_caches(spark)
