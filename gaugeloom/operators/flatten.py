"""Nested records as flat, related tables, made from Arrow list offsets and parent indices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _plain(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _child(array: pa.Array, name: str) -> pa.Array:
    """Field of a struct array; null where the struct is null."""
    return pc.struct_field(array, name)


def _explode(array: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Values of a list array, the row each belongs to and its 0-based place; null and empty lists give none."""
    parent = pc.list_parent_indices(array)
    flat = pc.list_flatten(array)
    lengths = pc.fill_null(pc.list_value_length(array), 0).cast(pa.int64())
    ends = pc.cumulative_sum(lengths)
    starts = pc.subtract(ends, lengths)
    ordinal = pa.array(np.arange(len(flat), dtype=np.int64))
    place = pc.subtract(ordinal, pc.take(starts, parent))
    return flat, parent, place.cast(pa.int32())


def _leaves(t: T.DataType, prefix: str = "") -> list[tuple[str, list[str], T.DataType]]:
    """Columns of a struct without lists of structs: flat name, path, type. Lists of plain values stay out."""
    out = []
    for f in t.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += [(n, [f.name, *p], x) for n, p, x in _leaves(f.dataType, name + "_")]
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append((name, [f.name], f.dataType))
    return out


def _type_at(t: T.DataType, path: list[str]) -> T.DataType:
    """Type at a path of field names; a list on the way is stepped into."""
    for p in path:
        while isinstance(t, T.ArrayType):
            t = t.elementType
        t = t[p].dataType
    return t


def _walk(batch: pa.RecordBatch, path: list[str]) -> pa.Array:
    a = _plain(batch.column(batch.schema.get_field_index(path[0])))
    for p in path[1:]:
        a = _child(a, p)
    return a


def _descend(batch: pa.RecordBatch, path: list[str]) -> tuple[pa.Array, pa.Array, list[pa.Array]]:
    """Values at a path whose lists are all opened, also the last: values, the row each belongs to, and its place in every list passed.

    Null entries stay until the end; the places of outer lists are taken along by parent indices.
    """
    a = _plain(batch.column(batch.schema.get_field_index(path[0])))
    rows, places = pa.array(np.arange(len(a), dtype=np.int64)), []

    def open_lists(a, rows, places):
        while pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
            a, parent, place = _explode(a)
            rows, places = rows.take(parent), [p.take(parent) for p in places] + [place]
        return a, rows, places

    for p in path[1:]:
        a, rows, places = open_lists(a, rows, places)
        a = _child(a, p)
    return open_lists(a, rows, places)


def _lists_on(t: T.DataType, path: list[str]) -> list[str]:
    """Names of the place columns of a path, outermost first: ``pos`` of the last list, ``<field>_pos`` of those before it."""
    names, at = [], t
    for p in path:
        while isinstance(at, T.ArrayType):
            at = at.elementType
        at, k = at[p].dataType, 0
        x = at
        while isinstance(x, T.ArrayType):
            names.append(f"{p}_pos" if not k else f"{p}_{k}_pos")
            x, k = x.elementType, k + 1
    return [*names[:-1], "pos"] if names else ["pos"]


def child_table(df: DataFrame, key: str, path: str, fields: list[str] | None = None) -> DataFrame:
    """One row per non-null entry of the list at ``path`` (dotted), or per present struct there.

    Columns: the key of the parent row, ``pos`` (int, 0-based place in the list; null entries
    keep their place; 0 for a struct) and, for objects, their plain fields (nested structs as
    ``a_b``), else ``value``. A path may lead through lists at any depth, and lists of lists are
    opened too: the places in the outer lists then come before ``pos`` as ``<field>_pos``, so
    that (key, outer places) are the (key, pos) of the row in the outer list's own table.
    Absent structs on the way, null lists and empty lists give no row. Repeated parent rows give
    repeated child rows. Only the columns named are read. Parent columns called pos or value do
    not clash, as only the key is carried.
    """
    parts = path.split(".")
    item = _type_at(df.schema, parts)
    while isinstance(item, T.ArrayType):
        item = item.elementType
    places = _lists_on(df.schema, parts)
    if isinstance(item, T.StructType):
        cols = [c for c in _leaves(item) if fields is None or c[0] in fields]
    else:
        cols = [("value", [], item)]
    taken = {p.lower() for p in places}
    names = [f"{key}_parent" if n == key else f"{n}_" if n.lower() in taken else n for n, _, _ in cols]
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)] + [T.StructField(p, T.IntegerType()) for p in places]
        + [T.StructField(n, t) for n, (_, _, t) in zip(names, cols)]
    )
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def emit(batches):
        for b in batches:
            keys = b.column(b.schema.get_field_index(key))
            flat, rows, at = _descend(b, parts)
            at = at or [pa.array(np.zeros(len(flat), np.int32))]
            keep = flat.is_valid()
            flat, out = flat.filter(keep), [keys.take(rows.filter(keep)), *(p.filter(keep) for p in at)]
            for _, p, _ in cols:
                x = flat
                for step in p:
                    x = _child(x, step)
                out.append(x)
            yield pa.RecordBatch.from_arrays([_plain(x).cast(t) for x, t in zip(out, arrow)], names=schema.names)

    return df.select(key, parts[0]).mapInArrow(emit, schema)


def list_paths(t: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all lists in a schema, at any depth, outer ones first."""
    out = []
    for f in t.fields:
        x, path = f.dataType, f"{prefix}{f.name}"
        if isinstance(x, T.ArrayType):
            out.append(path)
        while isinstance(x, T.ArrayType):
            x = x.elementType
        if isinstance(x, T.StructType):
            out += list_paths(x, path + ".")
    return out


def related_tables(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """All flat tables of nested records: the parent table under the empty path, and one child table per list at any depth."""
    return {"": parent_table(df, key), **{p: child_table(df, key, p) for p in list_paths(df.schema)}}


def child_positions(df: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """(key, child, pos) for every entry at each of the paths, in one pass over the table.

    Same rules as ``child_table``; ``child`` is the path.
    """
    kinds = [isinstance(_type_at(df.schema, p.split(".")), T.ArrayType) for p in paths]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("child", T.StringType()), T.StructField("pos", T.IntegerType())])
    key_type = to_arrow_type(schema[0].dataType)

    def emit(batches):
        for b in batches:
            keys = b.column(b.schema.get_field_index(key)).cast(key_type)
            for path, is_list in zip(paths, kinds):
                a = _walk(b, path.split("."))
                if is_list:
                    flat, parent, place = _explode(a)
                    keep = flat.is_valid()
                    parent, place = parent.filter(keep), place.filter(keep)
                else:
                    parent = pc.indices_nonzero(a.is_valid()).cast(pa.int64())
                    place = pa.array(np.zeros(len(parent), np.int32))
                yield pa.RecordBatch.from_arrays([keys.take(parent), pa.array([path] * len(parent), pa.string()), place], names=schema.names)

    return df.select(key, *dict.fromkeys(p.split(".")[0] for p in paths)).mapInArrow(emit, schema)


#: Children of an item record that are counted per entry.
ITEM_CHILDREN = ["options", "answer.correct_option_ids", "answer.target_coarse_parts", "answer.target_part8s", "person_image.focus"]


def item_children(items: DataFrame) -> DataFrame:
    """(item_row, child, pos) of every child object of the items."""
    return child_positions(items, "item_row", ITEM_CHILDREN)


#: Lists of plain values in an item's answer.
ANSWER_LISTS = ["answer.correct_option_ids", "answer.target_coarse_parts", "answer.target_part8s"]


def answer_values(items: DataFrame) -> DataFrame:
    """(item_row, child, pos, value) of the answer's lists."""
    from pyspark.sql import functions as F

    parts = [child_table(items, "item_row", p).select("item_row", F.lit(p).alias("child"), "pos", "value") for p in ANSWER_LISTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parent_table(df: DataFrame, key: str) -> DataFrame:
    """The flat parent table: the key and every plain field outside lists, nested structs as ``a_b``.

    One row per record; absent structs give null columns. Built from column projections alone.
    A nested field whose flat name already exists gets a trailing underscore.
    """
    from pyspark.sql import functions as F

    seen, cols = set(), []
    for name, path, _ in _leaves(df.schema):
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(name))
    return df.select(*cols)
