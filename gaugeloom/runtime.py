"""Session helpers: input tables, the shared folder, skew-safe joins."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as white space around identifiers (Unicode White_Space).
WHITESPACE = "".join(
    map(chr, [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet is read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder all executors share; it goes when the driver's JVM ends.

    The place is ``spark.checkpoint.dir``. Only a local session may leave that unset, as in
    tests: its one machine's temporary folder takes the place then. Settings are only read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir()).as_uri()
    at = f"{root.rstrip('/')}/gaugeloom-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{at}/data"


def _file_system(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, at: str) -> None:
    """Removes a folder of intermediate data."""
    fs, path = _file_system(spark, at)
    fs.delete(path, True)


def exists(path: str) -> bool:
    """Whether a file or folder is there, on any file system the session knows."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).exists()
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def read_text(path: str) -> str:
    """A small text file whole, on any file system the session knows."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).read_text()
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, content: str) -> None:
    """A small text file, written beside its place and then moved there; its folders are made. A failed write leaves the old file."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        p = Path(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        beside = p.with_suffix(p.suffix + ".tmp")
        beside.write_text(content)
        beside.replace(p)
        return
    fs, at = _file_system(spark, path)
    _, beside = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(content.encode("utf-8")))
        finally:
            stream.close()
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"could not move {beside} to {path}")
    finally:
        fs.delete(beside, False)


def copy(source: str, target: str) -> None:
    """A file or folder copied to another place, replacing what is there."""
    spark = SparkSession.getActiveSession()
    (fs, a), (other, b) = _file_system(spark, source), _file_system(spark, target)
    other.delete(b, True)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {source} to {target}")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: cuts its lineage, and later steps read instead of computing again."""
    at = shared_dir(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded(df: DataFrame, limit: int) -> list:
    """All rows, on the driver; more than ``limit`` are an error, none is left out."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def per_worker(key, make):
    """make(), once per Python worker and key; a worker runs many tasks, while what travels with a function lives for one."""
    held = sys.modules.setdefault("_gaugeloom_held", types.ModuleType("_gaugeloom_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_id(c: Column) -> Column:
    """Identifier without surrounding white space, in lower case."""
    return F.lower(F.btrim(c, F.lit(WHITESPACE)))


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO 8601 text; UTC where it names no offset.

    ``T`` or a space between date and time, ``Z``, ``+hh:mm`` and ``+hhmm`` are read.
    Text that is no instant gives null.
    """
    t = F.upper(F.btrim(c, F.lit(WHITESPACE)))
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    offset = t.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & ~day
    plain = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", r"$1:$2")
    whole = F.when(day, F.concat(t, F.lit("T00:00:00Z"))).when(offset, plain).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(whole.try_cast("timestamp"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in at least as many partitions as there are cores, for steps that cost far more than moving their rows.

    Inputs in enough splits, as on any large table, stay as they are, and so does what comes
    out of a shuffle (counting its partitions would run it). Others are hashed by keys, so
    that a task that runs again sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if run.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or run.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


TRACKED = 10_000  # values a sketch of frequent ones holds


def heavy_keys(df: DataFrame, key: str, parts: int) -> list:
    """Values of key that may hold more than one part in ``parts`` of the rows; never more than ``parts`` values.

    One pass with a sketch of frequent values, combined map-side; none that holds such a share
    is missed as long as parts is under ``TRACKED``, and one named too many does no harm.
    """
    k = min(parts, TRACKED)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in r["top"] or [] if x["item"] is not None and x["count"] * parts > r["n"]]


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], how: str = "inner", salts: int = 0, partitions: int | None = None, heavy: list | None = None) -> DataFrame:
    """Equi-join on ``key`` whose heavy keys are split over several tasks.

    left: the side that may hold a third of its rows under one key. Rows of a heavy key
    get a salt from a hash of ``salt_by`` (stable when a lost task is run again); right
    rows of these few keys are repeated once per salt. Other rows are joined as usual.
    how: inner, left, left_semi or left_anti. The key column comes out once, from the left.
    partitions: keep so many tasks after the join, where what follows is costly per row; else
    small partitions are coalesced.
    heavy: the heavy keys, where they are known; else they are looked for in left.
    """
    spark = left.sparkSession
    parts = max(8, shuffle_partitions(spark))
    heavy = heavy_keys(left.select(key), key, parts) if heavy is None else heavy
    if not heavy:
        return (left.repartition(partitions, key) if partitions else left).join(right, key, how)
    n = salts or min(64, parts)
    hot = F.col(key).isin(heavy)
    salted = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*salt_by), F.lit(n)).cast("int")).otherwise(0))
    if partitions:
        salted = salted.repartition(partitions, key, "_salt")
    repeated = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", nulls_match: bool = False) -> DataFrame:
    """left with the columns of right of the same keys; right is unique per key. Heavy keys of left stay spread.

    nulls_match: null key parts are equal to each other, else they match nothing.
    """
    text = lambda: F.to_json(F.struct(*[F.col(k) for k in keys]))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    key = text() if nulls_match else F.when(whole, text())
    salt_by = [f.name for f in left.schema.fields if not isinstance(f.dataType, T.MapType)]
    joined = salted_join(left.withColumn("_match", key), right.withColumn("_match", key).drop(*keys), "_match", salt_by, how)
    return joined.drop("_match")
