"""Readers of record files: JSON lines, JSON documents, COCO, prediction folders, images."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeloom import schemas
from gaugeloom.runtime import exists, read_text


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, pattern: str | None = None) -> DataFrame:
    """Records of JSON-lines files, lazily; blank lines do not count. strict: a bad line is an error, else it is left out."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def coco(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, schemas.COCO)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 if there is no such file."""
    if not exists(path):
        return 0
    return spark.read.text(path).where(F.trim("value") != "").count()


def with_origin(df: DataFrame) -> DataFrame:
    """Adds _path and _row, the order of lines within files, for last-wins rules."""
    return df.withColumn("_path", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())


def keyed(df: DataFrame, key: str, required: bool = False) -> DataFrame:
    """The last record of each key in file order. required: a blank key is an error, else it is left out."""
    from gaugeloom.operators.scoring import last_per_key

    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    rows = df.where(F.assert_true(~blank, F.lit(f"record without {key}")).isNull()) if required else df.where(~blank)
    return last_per_key(rows, [key], ["_path", "_row"]).drop("_path", "_row")


def discover(path: str, prefer: str = "predictions.jsonl") -> list[str]:
    """Files of a path, folder or glob: those named ``prefer``, else all *.jsonl; sorted."""
    p = Path(path)
    if p.is_file():
        return [str(p)]
    found = p.rglob("*.jsonl") if p.is_dir() else (x for g in p.parent.glob(p.name) for x in ([g] if g.is_file() else g.rglob("*.jsonl")))
    files = sorted({str(x) for x in found})
    named = [f for f in files if Path(f).name == prefer]
    return named or files


def predictions_by_model(spark: SparkSession, path: str, schema: str = schemas.PREDICTION) -> DataFrame:
    """Records of all prediction files with column model: the only model name a file has, else its folder without a date."""
    df = json_lines(spark, discover(path), schema).withColumn("_path", F.col("_metadata.file_path"))
    named = F.coalesce(F.nullif(F.trim("model_name"), F.lit("")), F.nullif(F.trim("model_id"), F.lit("")))
    per_file = df.groupBy("_path").agg(F.count_distinct(named).alias("n"), F.min(named).alias("m"))
    folder = F.regexp_replace(F.element_at(F.split("_path", "/"), -2), r"_\d{8}$", "")
    names = per_file.select("_path", F.when(F.col("n") == 1, F.col("m")).otherwise(folder).alias("model"))
    return df.join(names, "_path")


def metric_files(spark: SparkSession, root: str, pattern: str = "*.metrics.json") -> DataFrame:
    """Metric documents below a folder, the last path of a (variant, model) winning."""
    from gaugeloom.operators.scoring import last_per_key

    df = spark.read.schema(schemas.METRICS).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
    return last_per_key(df.withColumn("_path", F.col("_metadata.file_path")), ["variant", "model_name"], ["_path"])


def unreadable_files(spark: SparkSession, root: str, pattern: str = "*.metrics.json") -> DataFrame:
    """(path) of JSON documents below a folder that cannot be read; the readers of reports leave them out."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return texts.where(F.get_json_object("value", "$").isNull()).select(F.col("_metadata.file_path").alias("path"))


def from_template(template: str, **values: str) -> str:
    """A path with its ``{model}`` and other places filled; a place without a value is an error."""
    return template.format(**values)


def cached(df: DataFrame) -> DataFrame:
    """df kept in memory and on disk once computed, for several uses; lost parts are computed again."""
    return df.persist()


def drop_caches(spark: SparkSession) -> None:
    spark.catalog.clearCache()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file, none if it does not exist."""
    return json_lines(spark, path, schema) if exists(path) else spark.createDataFrame([], schema)


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, content) of image files; decoding is left to the caller's image library."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def yaml_config(path: str) -> dict:
    """A YAML file, where PyYAML is installed; an empty file gives an empty dict."""
    import yaml

    return yaml.safe_load(read_text(path)) or {}


def alias_table(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(canonical, alias, policy_version) of a YAML alias file; another version than asked for is an error."""
    doc = yaml_config(path)
    found = str(doc.get("policy_version", ""))
    if version is not None and found != version:
        raise ValueError(f"alias file has version {found}, not {version}")
    rows = [(c, a, found) for c, aliases in (doc.get("aliases") or {}).items() for a in aliases or []]
    return spark.createDataFrame(rows, "canonical string, alias string, policy_version string")


def policy_version(path: str) -> str:
    """First policy_version line of a text file."""
    for line in read_text(path).splitlines():
        m = re.match(r"\W*policy_version\W*:\W*([\w.]+)", line, re.IGNORECASE)
        if m:
            return m.group(1)
    raise ValueError(f"no policy_version in {path}")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def prompts(path: str, key: str) -> list[str]:
    """The list of prompts under a key of a JSON file; anything else there, or none, is an error."""
    import json

    found = json.loads(read_text(path)).get(key)
    if not isinstance(found, list) or not found:
        raise ValueError(f"no prompts under {key} in {path}")
    return [str(p) for p in found]


def confusion_cells(spark: SparkSession, path: str, drop_empty: list[str] = ()) -> DataFrame:
    """(target, pred, n) of the ``confusion`` section of metric documents, whole rows of zeros dropped for the given targets."""
    df = spark.read.schema("confusion map<string,map<string,bigint>>").option("multiLine", "true").json(path)
    cells = df.select(F.explode("confusion").alias("target", "row")).select("target", F.explode("row").alias("pred", "n"))
    if not drop_empty:
        return cells
    sums = cells.groupBy("target").agg(F.sum("n").alias("total"))
    return cells.join(sums, "target").where(~F.col("target").isin(list(drop_empty)) | (F.col("total") > 0)).drop("total")
