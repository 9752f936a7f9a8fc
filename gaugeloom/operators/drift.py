"""Schemas that drift between files: the list of changes, and one consistent table."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeloom.functions.treedit import edit_script
from gaugeloom.runtime import shuffle_partitions, spread, written

#: Fields that name a record: of items, and of predictions.
RECORD_KEYS = {"items": ["item_id"], "predictions": ["item_id", "model_id", "timestamp"]}

LEAF_ARROW = [("path", pa.string()), ("type", pa.string()), ("p", pa.int64()), ("v", pa.int64())]
LEAF = "path:string,type:string,p:bigint,v:bigint"


def value_type(v) -> str | None:
    """string, whole, decimal, boolean, or array<one of these>; nulls and empty arrays have none."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "whole"
    if isinstance(v, float):
        return "decimal"
    if isinstance(v, str):
        return "string"
    if isinstance(v, list):
        kinds = sorted({k for k in map(value_type, v) if k})
        return f"array<{'|'.join(kinds)}>" if kinds else None
    return None


def record_leaves(record: dict) -> dict[str, tuple[str | None, object]]:
    """Path to (type, value) of each leaf with a non-null value; arrays of objects give a list of values per leaf."""
    out: dict[str, tuple[str | None, object]] = {}

    def walk(node, path):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(node, list) and any(isinstance(x, dict) for x in node):
            rows = [record_leaves(x) if isinstance(x, dict) else {"": (value_type(x), x)} for x in node]
            for sub in dict.fromkeys(k for r in rows for k in r):
                values = [r.get(sub, (None, None)) for r in rows]
                kinds = sorted({t for t, _ in values if t})
                out[f"{path}[].{sub}" if sub else f"{path}[]"] = ("|".join(kinds) or None, [v for _, v in values])
        elif node is not None:
            out[path] = (value_type(node), node)

    walk(record, "")
    return out


def read_record(payload: str | None) -> dict | None:
    """The JSON object of a line; null where the line is unreadable or no object."""
    try:
        record = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _canon(v) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=True)


LINE = ["stream_id", "file_id", "file_no", "line_no", "received_at"]


def records_with_leaves(raw: DataFrame, with_values: bool = False) -> DataFrame:
    """(stream_id, file_id, file_no, rec, readable, leaves) of each line, with line_no and received_at where values are asked for.

    rec names the record; it is null for lines that cannot be read and records without their key
    fields. leaves have hashes of path and value; with_values, the value's JSON text as well.
    """
    columns = LINE if with_values else LINE[:3]
    schema = f"stream_id bigint, file_id bigint, file_no int, {'line_no bigint, received_at timestamp, ' if with_values else ''}rec string, readable boolean, leaves array<struct<{LEAF}{',json:string' if with_values else ''}>>"
    leaf = pa.list_(pa.struct([*LEAF_ARROW, *([("json", pa.string())] if with_values else [])]))

    def emit(batches):
        for b in batches:
            recs, readable, all_leaves = [], [], []
            for payload, kind in zip(b.column("payload").to_pylist(), b.column("record_kind").to_pylist()):
                record = read_record(payload)
                readable.append(record is not None)
                if record is None:
                    recs.append(None)
                    all_leaves.append([])
                    continue
                key = [record.get(k) for k in RECORD_KEYS.get(kind, ["item_id"])]
                recs.append(None if any(k is None for k in key) else _canon(key))
                rows = []
                for p, (t, v) in record_leaves(record).items():
                    text = _canon(v)
                    row = {"path": p, "type": t, "p": _hash(p), "v": _hash(f"{t}:{text}")}
                    if with_values:
                        row["json"] = text
                    rows.append(row)
                all_leaves.append(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in columns), pa.array(recs, pa.string()), pa.array(readable, pa.bool_()), pa.array(all_leaves, leaf)], names=[*columns, "rec", "readable", "leaves"])

    kinds = dict(zip(LINE, ("bigint", "bigint", "int", "bigint", "timestamp")))
    source = raw.select(*[F.col(c).cast(kinds[c]) for c in columns], "record_kind", "payload")
    return spread(source, "file_id", "payload").mapInArrow(emit, schema)


def _fields_of(leaves: list) -> dict[str, str | None]:
    """Path to type of one file; a path with several types names them all."""
    kinds: dict[str, set] = {}
    for x in leaves if leaves is not None else []:
        kinds.setdefault(x["path"], set()).update((x["type"] or "").split("|") if x["type"] and not x["type"].startswith("array<") else [x["type"] or ""])
    return {p: "|".join(sorted(t - {""})) or None for p, t in kinds.items()}


def file_changes(raw: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field): what changed from each file to the next of its stream.

    The fields of a file, their types, and how often two fields hold the same value in records
    that both files export are aggregated map-side, so that a file with a third of all lines
    is never one group. The edit script then sees one small row per pair of files: the leaves
    of two schemas and counts of agreeing values.

    Nulls: a line with a null or unreadable payload is skipped; a record without its key fields
    adds its fields but no evidence. Lines delivered twice change nothing. A gap in file_no
    leaves the later file without changes. An empty table gives an empty result. Long payloads
    are read whole. Columns besides the named ones are ignored.
    """
    # Lines are parsed once, into the shared folder, and read for fields and for evidence.
    return _changes(written(records_with_leaves(raw)))


def _changes(lines: DataFrame) -> DataFrame:
    spark = lines.sparkSession
    files = lines.groupBy("stream_id", "file_no", "file_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    fields = (
        lines.select("stream_id", "file_no", "file_id", F.explode("leaves").alias("x"))
        .groupBy("stream_id", "file_no", "file_id").agg(F.collect_set(F.struct("x.path", "x.type", "x.p")).alias("fields"))
    )
    files = files.join(fields, ["stream_id", "file_no", "file_id"], "left")
    pairs = files.alias("b").join(
        files.alias("a"), (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.file_no") + 1 == F.col("b.file_no"))
    ).select("b.stream_id", "b.file_no", "b.file_id", F.col("a.fields").alias("old"), F.col("b.fields").alias("new"))

    short = lines.where("rec is not null").select("stream_id", "file_no", "rec", F.transform("leaves", lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v"))).alias("l"))
    both = short.select("stream_id", (F.col("file_no") + 1).alias("file_no"), "rec", F.col("l").alias("a")).join(
        short.withColumnRenamed("l", "b"), ["stream_id", "file_no", "rec"]
    )
    gone = F.filter("a", lambda x: ~F.exists("b", lambda y: y["p"] == x["p"]))
    fresh = F.filter("b", lambda y: ~F.exists("a", lambda x: y["p"] == x["p"]))
    none = F.lit(0).cast("bigint")
    seen = both.select("stream_id", "file_no", gone.alias("g"), fresh.alias("f")).select(
        "stream_id", "file_no",
        F.explode(
            F.concat(
                F.transform("g", lambda x: F.struct(x["p"].alias("p"), none.alias("q"))),
                F.transform("f", lambda y: F.struct(none.alias("p"), y["p"].alias("q"))),
                F.flatten(F.transform("g", lambda x: F.transform(F.filter("f", lambda y: y["v"] == x["v"]), lambda y: F.struct(x["p"].alias("p"), y["p"].alias("q"))))),
            )
        ).alias("e"),
    )
    evidence = seen.groupBy("stream_id", "file_no", "e").count().groupBy("stream_id", "file_no").agg(
        F.collect_list(F.struct(F.col("e.p").alias("p"), F.col("e.q").alias("q"), F.col("count").alias("n"))).alias("evidence")
    )

    def scripts(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                old, new = _fields_of(r.old), _fields_of(r.new)
                for side in (old, new):  # an empty array where other records hold objects is no field
                    for p in [p for p, t in side.items() if t is None and any(x.startswith(p + "[].") for x in (*old, *new))]:
                        del side[p]
                name = {x["path"]: x["p"] for side in (r.old, r.new) if side is not None for x in side}
                n = {(x["p"], x["q"]): x["n"] for x in (r.evidence if r.evidence is not None else [])}

                def same(p, q):
                    k = n.get((name[p], name[q]), 0)
                    return k > 0 and k == n.get((name[p], 0), 0) == n.get((0, name[q]), 0)

                rows += [(r.file_id, *step) for step in edit_script(old, new, same)]
            yield pd.DataFrame(rows, columns=["file_id", "change", "old_field", "new_field"])

    ready = pairs.join(evidence, ["stream_id", "file_no"], "left").select("file_id", "old", "new", "evidence")
    return ready.repartition(shuffle_partitions(spark), "file_id").mapInPandas(
        scripts, "file_id bigint, change string, old_field string, new_field string"
    )


def canonical_names(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(stream_id, file_no, names): map from each renamed field's name in that file to its first name in the stream.

    files: (stream_id, file_id, file_no), in any number of rows. The scripts of a stream are
    composed in file order; a stream's scripts are metadata (a few rows per file, none of the
    records).
    """
    files = files.select("stream_id", "file_id", "file_no").distinct()
    steps = files.join(changes.where("change in ('renamed', 'removed')"), "file_id", "left")

    def compose(pdf):
        first: dict[str, str] = {}
        out = []
        for no, part in pdf.sort_values("file_no").groupby("file_no", sort=True):
            renamed = [(o, n) for c, o, n in zip(part.change, part.old_field, part.new_field) if c == "renamed"]
            update = {n: first.get(o, o) for o, n in renamed}
            for c, o in zip(part.change, part.old_field):
                if isinstance(c, str):
                    first.pop(o, None)
            first.update(update)
            out.append((int(part.stream_id.iloc[0]), int(no), {k: v for k, v in first.items() if k != v}))
        return pd.DataFrame(out, columns=["stream_id", "file_no", "names"])

    return steps.groupBy("stream_id").applyInPandas(compose, "stream_id bigint, file_no int, names map<string,string>")


#: Spark type of a field that only ever has one type.
SPARK_TYPES = {"whole": "bigint", "decimal": "double", "boolean": "boolean", "string": "string", "array<string>": "array<string>", "array<whole>": "array<bigint>", "array<decimal>": "array<double>", "array<boolean>": "array<boolean>"}


def _column_type(kinds: set[str]) -> str:
    if len(kinds) == 1:
        return SPARK_TYPES.get(next(iter(kinds)), "string")
    return "double" if kinds == {"whole", "decimal"} else "array<double>" if kinds == {"array<whole>", "array<decimal>"} else "string"


def consistent_table(raw: DataFrame, kind: str, max_columns: int = 500) -> DataFrame:
    """All records of one kind as one table: a column per field, under its first name in its stream.

    Lines are parsed once, for the changes and for the values. The edit scripts, composed per stream, become a projection per file: each leaf is put under
    its canonical name, and each column gets the narrowest type that holds all its values
    (whole numbers and decimals: double; otherwise differing types: the JSON text). Fields
    beyond max_columns (most frequent first) stay, as JSON text, in the map column ``extra``.
    Columns: stream_id, file_id, file_no, line_no, received_at, one per field (dots and brackets
    become underscores), extra. Leaves of arrays of objects are arrays, in order of the objects.
    Lines exported or delivered again stay separate rows. Unreadable lines are left out.
    """
    lines = written(records_with_leaves(raw.where(F.col("record_kind") == kind), with_values=True))
    names = canonical_names(lines, _changes(lines))
    keep = LINE
    entries = F.transform("leaves", lambda x: F.struct(F.coalesce(F.try_element_at("names", x["path"]), x["path"]).alias("key"), F.struct(x["type"].alias("type"), x["json"].alias("json")).alias("value")))
    # Should two fields of a record come under one name, the first stays.
    first = F.aggregate(entries, F.array().cast("array<struct<key:string,value:struct<type:string,json:string>>>"), lambda out, e: F.when(F.exists(out, lambda o: o["key"] == e["key"]), out).otherwise(F.concat(out, F.array(e))))
    named = written(lines.where("readable").join(names, ["stream_id", "file_no"], "left").select(*keep, F.map_from_entries(first).alias("leaves")))
    stats = named.select(F.explode("leaves")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.collect_set("value.type").alias("types")).orderBy(F.desc("n"), "key").limit(max_columns).collect()
    taken, cols = set(k.lower() for k in keep) | {"extra"}, []
    for r in sorted(stats, key=lambda r: r["key"]):
        column = "".join(c if c.isalnum() else "_" for c in r["key"].replace("[].", "__")).strip("_")
        while column.lower() in taken:
            column += "_"
        taken.add(column.lower())
        kinds = {t for t in r["types"] if t}
        repeated = "[]" in r["key"]
        to = _column_type({f"array<{t}>" if repeated else t for t in kinds} or {"string"})
        text = F.try_element_at("leaves", F.lit(r["key"]))["json"]
        if to == "string":
            value = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
        elif to.startswith("array"):
            value = F.from_json(text, to)
        else:
            value = text.try_cast(to)
        cols.append(value.alias(column))
    known = F.array(*[F.lit(r["key"]) for r in stats]) if stats else F.array().cast("array<string>")
    extra = F.transform_values(F.map_filter("leaves", lambda k, v: ~F.array_contains(known, k)), lambda k, v: v["json"]).alias("extra")
    return named.select(*keep, *cols, extra)
