"""Column functions on model text: normalization, the greedy phrase parser, answer extraction, names.

Regular expressions are kept to what Java and RE2 read alike, except for Unicode classes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates items of a free-form answer.
SEPARATORS = r"\s*(?:,|;|\bas well as\b|\band\b)\s*"


def squeeze(c: Column) -> Column:
    """Trimmed, lower case, runs of any white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Only texts outside ASCII go to Python; the others pass as they are."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)

    wide = c.rlike(r"[^\x00-\x7f]")
    return F.when(wide, normal(F.when(wide, c))).otherwise(c)


def strip_punctuation(c: Column) -> Column:
    """Characters other than letters, digits and - / , ; become blanks; no blanks around , and ;."""
    kept = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\-/,;\s]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(kept, r"(?U)\s+", " ")), r"\s*([,;])\s*", "$1")


def normal_text(c: Column, unicode: bool = True) -> Column:
    one = squeeze(c)
    return strip_punctuation(nfkc(one) if unicode else one)


def split_items(c: Column) -> Column:
    """Items of a normalized answer between separators, cleaned again, blanks dropped."""
    return F.filter(F.transform(F.split(c, SEPARATORS), lambda x: strip_punctuation(squeeze(x))), lambda x: x != "")


class AliasTable:
    """Aliases of canonical labels as one ordered alternation, so that the greedy parser needs no UDF.

    Longer phrases (in tokens, then letters) come first. In a text with doubled blanks an
    alternation framed by blanks takes, at each token, the longest phrase that starts there,
    as a greedy token loop does.
    """

    def __init__(self, entries: list[tuple[str, str]], versions: list[str] = (), wanted: str | None = None):
        """entries: (canonical, alias) in file order; a later equal alias wins. wanted: version all must have."""
        if wanted is not None and set(versions) != {wanted}:
            raise ValueError(f"alias table has versions {sorted(set(versions))}, not {wanted}")
        clean = lambda t: " ".join(re.sub(r"[^\w\-/,; ]|_", " ", t.strip().lower()).split())
        table: dict[str, str] = {}
        for canonical in dict.fromkeys(c for c, _ in entries):
            for alias in [canonical, *(a for c, a in entries if c == canonical)]:
                if clean(alias):
                    table[clean(alias)] = canonical
        self.table = table
        self.phrases = sorted(table, key=lambda p: (-len(p.split()), -len(p), p))
        self.pattern = " (" + "|".join(re.escape(p).replace(r"\ ", "  ").replace(r"\-", "-") for p in self.phrases) + ") "
        self.mapping = F.create_map(*[F.lit(x) for p, c in table.items() for x in (p, c)])

    @classmethod
    def from_frame(cls, df, canonical: str = "canonical", alias: str = "normalized_alias", limit: int = 20_000) -> "AliasTable":
        """From a table of at most ``limit`` aliases, which is its proven bound."""
        rows = df.select(canonical, alias).distinct().orderBy(canonical, alias).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} aliases")
        return cls([(r[0], r[1]) for r in rows])

    def _framed(self, item: Column) -> Column:
        return F.concat(F.lit(" "), F.regexp_replace(item, " ", "  "), F.lit(" "))

    def labels(self, item: Column) -> Column:
        """Canonical labels of an item, in order, with repeats."""
        found = F.regexp_extract_all(self._framed(item), F.lit(self.pattern), 1)
        return F.transform(found, lambda p: F.try_element_at(self.mapping, F.regexp_replace(p, "  ", " ")))

    def unresolved(self, item: Column) -> Column:
        """Runs of words of an item between its labels."""
        rest = F.split(self._framed(item), self.pattern)
        return F.filter(F.transform(rest, lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")

    def parse(self, raw: Column, valid: Column | None = None, unicode: bool = True) -> dict[str, Column]:
        """normalized_text, predicted_labels, unresolved_tokens, flags and parser_status of an answer.

        valid: labels that may be predicted; others found become unresolved tokens after the
        runs of their item. Labels keep the order in which they come first. An item that is an
        alias as a whole resolves to it.
        """
        text = normal_text(F.coalesce(raw, F.lit("")), unicode)
        items = split_items(text)
        parsed = F.transform(
            items,
            lambda i: F.when(F.map_contains_key(self.mapping, i), F.struct(F.array(F.try_element_at(self.mapping, i)).alias("l"), F.array().cast("array<string>").alias("u")))
            .otherwise(F.struct(self.labels(i).alias("l"), self.unresolved(i).alias("u"))),
        )
        found = F.flatten(F.transform(parsed, lambda p: p["l"]))
        if valid is None:
            good, rest = found, F.flatten(F.transform(parsed, lambda p: p["u"]))
        else:
            good = F.filter(found, lambda x: F.array_contains(valid, x))
            rest = F.flatten(F.transform(parsed, lambda p: F.concat(p["u"], F.filter(p["l"], lambda x: ~F.array_contains(valid, x)))))
        labels, blank = F.array_distinct(good), F.size(items) == 0
        flag = lambda on, name: F.when(on, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        return {
            "normalized_text": text,
            "predicted_labels": labels,
            "unresolved_tokens": rest,
            "flags": F.when(blank, F.array(F.lit("unparsable"))).otherwise(F.concat(flag(F.size(rest) > 0, "hallucinated"), flag(F.array_contains(labels, "none_visible"), "none_visible_marker"))),
            "parser_status": F.when(blank, "unparsable").when(F.size(rest) > 0, "hallucinated").otherwise("ok"),
        }


def presence_by_position(raw: Column) -> Column:
    """Answer of a JSON object, else the first standalone a-d of the text."""
    answer = F.lower(F.trim(F.get_json_object(raw, "$.answer")))
    letter = F.regexp_extract(F.lower(raw), r"(?:^|[^a-z0-9_])([abcd])(?:[^a-z0-9_]|$)", 1)
    return F.when(answer.isin(list("abcd")), answer).otherwise(F.nullif(letter, F.lit("")))


def presence_by_letter(parsed: Column, raw: Column) -> Column:
    """A valid parsed answer, else the alphabetically first of a-d that stands alone in the text."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    out = F.lit(None).cast("string")
    for letter in "dcba":
        out = F.when(low.rlike(rf"(?:^|[^a-z0-9_]){letter}(?:[^a-z0-9_]|$)"), letter).otherwise(out)
    given = F.lower(F.trim(parsed))
    return F.when(given.isin(list("abcd")), given).otherwise(out)


def segment_labels(raw: Column, vocabulary: list[str]) -> Column:
    """Labels of a JSON object as they stand, else comma tokens that are in the vocabulary; first occurrence kept."""
    given = F.from_json(F.get_json_object(raw, "$.labels"), "array<string>")
    bare = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.btrim(x, F.lit(" \t\n`\"'")))
    known = F.filter(bare, lambda x: x.isin(vocabulary))
    return F.array_distinct(F.when(given.isNotNull(), F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != "")).otherwise(known))


def choice_token(c: Column, numeric: bool = False) -> Column:
    """A-H of a letter, or of a number 1-8 if numeric; else null."""
    t = F.upper(F.trim(c))
    out = F.when(t.rlike("^[A-H]$"), t)
    return out.when(t.rlike("^[1-8]$"), F.char(t.try_cast("int") + 64)) if numeric else out


def _choice_text(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"```json\s*", ""), r"```\s*", "")


def _choices_found(text: Column, listed: Column, single: Column, inside: Column, numeric: bool) -> Column:
    """Options by five ways in turn; null if none reads any."""
    none = F.lit(None).cast("array<string>")
    tokens = lambda a: F.array_distinct(F.array_compact(F.transform(a, lambda x: choice_token(x, numeric))))
    from_object = F.when(listed.startswith("["), tokens(F.from_json(listed, "array<string>")))
    from_single = F.when(single.rlike("^[A-H]$"), F.array(single))
    quoted = F.regexp_extract_all(inside, F.lit('"([A-H])"'), 1)
    digits = F.regexp_extract_all(inside, F.lit(r"\b([1-8])\b"), 1)
    entries = F.when(F.size(quoted) > 0, quoted).otherwise(digits) if numeric else quoted
    from_list = F.when(inside.isNotNull() & ((F.size(entries) > 0) | (F.trim(inside) == "")), tokens(entries))
    old = F.upper(F.regexp_extract(text, r"""(?i)(?:"choice"\s*:\s*"|'choice'\s*:\s*')([A-H])["']""", 1))
    from_old = F.when(old != "", F.array(old))
    alone = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-H])(?![A-Za-z0-9_])"), 1)))
    ways = [from_object, from_single, from_list, from_old, F.when(F.size(alone) > 0, alone)]
    if numeric:
        numbers = tokens(F.regexp_extract_all(text, F.lit(r"\b([1-8])\b"), 1))
        ways.append(F.when(F.size(numbers) > 0, numbers))
    return F.coalesce(*ways, none)


def with_choices(df: DataFrame, raw: str, choices: str = "choices_read", error: str = "error_read", numeric: bool = False) -> DataFrame:
    """df with the options read from a model answer, and whether none could be read (1 or 0).

    In turn: the first flat JSON object's choices list, or its single choice; a choices list
    anywhere; a "choice" entry; option letters that stand alone, in alphabetical order; with
    numeric, digits 1-8. Fences are dropped. Shared steps are columns of their own, so that
    they are worked out once per row.
    """
    inside = r'"choices"\s*:\s*\[([^\]]*)\]'
    staged = df.withColumn("_text", _choice_text(F.col(raw))).withColumn("_object", F.nullif(F.regexp_extract("_text", r"(\{[^}]*\})", 1), F.lit("")))
    staged = staged.withColumns({
        "_listed": F.get_json_object("_object", "$.choices"), "_single": F.upper(F.get_json_object("_object", "$.choice")), "_inside": F.when(F.col("_text").rlike(inside), F.regexp_extract("_text", inside, 1)),
    })
    staged = staged.withColumn("_found", _choices_found(F.col("_text"), F.col("_listed"), F.col("_single"), F.col("_inside"), numeric))
    read = {choices: F.coalesce("_found", F.array().cast("array<string>")), error: F.col("_found").isNull().cast("int")}
    return staged.withColumns(read).drop("_text", "_object", "_listed", "_single", "_inside", "_found")


def category_parts(name: Column, subtypes: list[str] = ("articulated", "functional", "cosmetic"), device: str = "pro") -> tuple[Column, Column, Column]:
    """(side, segment, kind) of a dashed category name; kind is residual, prosthesis or null.

    residual: the name ends with it. prosthesis: it ends with a subtype and the device word.
    """
    tokens = F.filter(F.transform(F.split(F.lower(F.trim(name)), "-"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.array_join(tokens, "-")
    padded = F.concat(F.lit("-"), plain, F.lit("-"))
    side = F.get(F.filter(tokens, lambda x: x.isin("left", "right")), F.lit(0))
    segment = (
        F.when(padded.contains("-upper-arm-"), "upper_arm").when(padded.rlike("-fore-?arm-"), "forearm").when(padded.contains("-thigh-"), "thigh").when(padded.contains("-calf-"), "calf")
    )
    kind = F.when(plain.rlike("(^|-)residual$"), "residual").when(plain.rlike(f"(^|-)({'|'.join(subtypes)})-{device}$"), "prosthesis")
    return side, segment, kind


def evidence_label(name: Column, **rule) -> Column:
    """segment_side_kind of a category name; null unless all three are known."""
    side, segment, kind = category_parts(name, **rule)
    return F.when(side.isNotNull() & segment.isNotNull() & kind.isNotNull(), F.concat_ws("_", segment, F.substring(side, 1, 1), kind))


def file_safe(c: Column) -> Column:
    """Ten characters that file names should not have become underscores."""
    return F.translate(c, '/\\: *?"<>|', "_" * 10)


def base_record(c: Column) -> Column:
    return F.substring_index(c, "::shuffle", 1)


def cell(c: Column, digits: int = 3, missing: str = "NA") -> Column:
    """A number with fixed digits, or the missing mark."""
    return F.when(c.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def duration(seconds: Column) -> Column:
    """Seconds as 1h 2m 5s; smaller units only where larger are 0 or also named."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def without_json_sentences(c: Column) -> Column:
    """Sentences that speak of JSON are dropped."""
    return F.trim(F.array_join(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: ~F.lower(x).contains("json")), " "))
