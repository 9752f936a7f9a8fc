"""Column functions for record keys, with the fallbacks older files need. Blank counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Trimmed text; null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def task(c: Column) -> Column:
    """Canonical task name; old names are known."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("recognition", "presence"), "recognition").when(t.isin("attribution", "segments"), "attribution").otherwise(c)


def option_record(item: Column, record: Column) -> Column:
    return F.coalesce(filled(item), filled(record), F.lit(""))


def text_record(record: Column, item: Column) -> Column:
    return F.coalesce(filled(record), filled(item), F.lit(""))


def group_join_key(group: Column, image: Column) -> Column:
    """The image, else the digits after ``img`` in the group, else the group."""
    return F.coalesce(image.cast("string"), F.nullif(F.regexp_extract(group, r"img(\d+)", 1), F.lit("")), group)


def record_prefix(record: Column, group: Column, prompt: Column) -> Column:
    """record id, else group::promptN, else group; none of them is an error."""
    made = F.when(filled(group).isNotNull() & prompt.isNotNull(), F.concat(group, F.lit("::prompt"), prompt.cast("string")))
    return F.coalesce(filled(record), made, filled(group), F.raise_error(F.lit("record without id and group")).cast("string"))


def variant(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def truth(c: Column, default: bool = False) -> Column:
    """A forgiving boolean."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def answer_space(declared: Column, option_count: Column, options: Column) -> Column:
    """Declared, else constrained where options are known, else freeform."""
    return F.coalesce(filled(declared), F.when((F.coalesce(option_count, F.lit(0)) > 0) | (F.coalesce(F.size(options), F.lit(0)) > 0), "constrained").otherwise("freeform"))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)
