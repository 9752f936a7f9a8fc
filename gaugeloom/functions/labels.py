"""Column functions on label sets: cleaning, set metrics, agreement and consistency.

All take and give Columns; null arrays count as empty sets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeloom import dims


def empty() -> Column:
    return F.array().cast("array<string>")


def as_set(c: Column) -> Column:
    """Distinct non-null entries in sorted order; null gives the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, empty()))))


def clean_labels(c: Column) -> Column:
    """Trimmed entries without blanks and without ``none``, order kept."""
    trimmed = F.transform(F.coalesce(c, empty()), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "none"))


def split_labels(c: Column) -> Column:
    """Entries of a comma list, trimmed, blanks dropped (``none`` stays)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_choices(choices: Column, selected: Column | None = None, choice: Column | None = None) -> Column:
    """Option letters as a sorted set in upper case: choices, else selected ids, else the single old choice."""
    chain = [choices] + ([selected] if selected is not None else [])
    if choice is not None:
        chain.append(F.when(F.coalesce(choice, F.lit("")) != "", F.array(choice)))
    raw = F.coalesce(*chain, empty())
    return as_set(F.filter(F.transform(F.array_compact(raw), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def first_filled(*arrays: Column) -> Column:
    """First array that is neither null nor empty, else the empty one."""
    out = empty()
    for a in reversed(arrays):
        out = F.when(F.size(F.coalesce(a, empty())) > 0, a).otherwise(out)
    return out


def ratio(a: Column, b: Column, otherwise: Column | float = 0.0) -> Column:
    """a / b as double; ``otherwise`` where b is 0."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), other)


def harmonic(p: Column, r: Column) -> Column:
    """F1 of precision and recall, 0 if both are 0."""
    return ratio(2 * p * r, p + r)


def set_metrics(gold: Column, pred: Column, empty_is_perfect: bool = True, failed: Column | None = None) -> dict[str, Column]:
    """exact, partial, precision, recall, f1, iou, tp, fp, fn of two sets.

    empty_is_perfect: two empty sets give precision, recall and F1 of 1, else 0 (as does
    any empty side). failed: rows whose metrics are all 0, such as parse errors.
    """
    tp = F.size(F.array_intersect(gold, pred))
    fp, fn = F.size(pred) - tp, F.size(gold) - tp
    both_empty = (F.size(gold) == 0) & (F.size(pred) == 0)
    perfect = F.when(both_empty, 1.0).otherwise(0.0) if empty_is_perfect else F.lit(0.0)
    precision, recall = ratio(tp, F.size(pred), perfect), ratio(tp, F.size(gold), perfect)
    out = {
        "exact": ((fp == 0) & (fn == 0)).cast("double"),
        "partial": ((tp > 0) | both_empty).cast("double"),
        "precision": precision,
        "recall": recall,
        "f1": harmonic(precision, recall),
        "iou": ratio(tp, F.size(gold) + fp, 1.0),
        "tp": tp,
        "fp": fp,
        "fn": fn,
    }
    if failed is not None:
        out = {k: F.when(failed, F.lit(0).cast("double" if k not in ("tp", "fp", "fn") else "int")).otherwise(v) for k, v in out.items()}
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets, 1 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 1.0)


def consistency(distinct: Column, n: Column) -> Column:
    """1 - (distinct - 1) / (n - 1); 1 for a single value, 0 for none."""
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - ratio(distinct - 1, n - 1)))


def hit_at_1(gold: Column, pred: Column) -> Column:
    """Exactly one option is picked, and it is right."""
    return ((F.size(pred) == 1) & F.arrays_overlap(gold, pred)).cast("double")


def composite_to_cues(labels: Column) -> Column:
    """Labels segment_side_kind as the set of their segments, sides and kinds; none or nothing is none_visible."""
    cleaned = F.filter(F.transform(F.array_compact(F.coalesce(labels, empty())), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    pattern = r"^(upper_arm|forearm|thigh|calf)_([lr])_(residual|prosthesis)$"
    fit = F.filter(cleaned, lambda x: x.rlike(pattern))
    cues = F.flatten(
        F.transform(
            fit,
            lambda x: F.array(
                F.regexp_extract(x, pattern, 1),
                F.when(F.regexp_extract(x, pattern, 2) == "l", "left").otherwise("right"),
                F.when(F.regexp_extract(x, pattern, 3) == "residual", "residual_limb").otherwise("prosthesis"),
            ),
        )
    )
    nothing = (F.size(cleaned) == 0) | ((F.size(cleaned) == 1) & (F.get(cleaned, F.lit(0)) == "none"))
    return F.when(nothing, F.array(F.lit("none_visible"))).otherwise(as_set(cues))


def ordered_labels(present: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's labels that are present, in vocabulary order."""
    return F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda x: F.array_contains(present, x))


def option_letters(n: Column) -> Column:
    """Letters A.. for n options."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))).otherwise(empty())


def none_option(options: Column, fields: list[str], aliases: list[str] = dims.NONE_ALIASES) -> Column:
    """option_id of the first option of which a text field is a none alias."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "-", "_"), r"\s+", " ")
    hit = F.filter(options, lambda o: F.exists(F.array(*[F.coalesce(clean(o[f]).isin(aliases), F.lit(False)) for f in fields]), lambda x: x))
    return F.get(hit, F.lit(0))["option_id"]


def option_attribute(options: Column, choice: Column, field: str) -> Column:
    """A field of the option with the given id."""
    return F.get(F.filter(options, lambda o: o["option_id"] == choice), F.lit(0))[field]
