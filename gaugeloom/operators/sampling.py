"""Reproducible sampling: option sets, subsets and permutations in md5 order, and control baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeloom import dims
from gaugeloom.functions import labels as L
from gaugeloom.operators.statistics import hash_draw, hash_order


def shuffled(array: Column, *seed: Column) -> Column:
    """The entries in order of md5(seed:entry); the same wherever the row lies."""
    keyed = F.array_sort(F.transform(array, lambda x: F.struct(hash_order(*seed, x).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def take_k(array: Column, k: Column, *seed: Column) -> Column:
    """k entries without replacement (all if there are fewer), sorted."""
    return F.array_sort(F.slice(shuffled(array, *seed), F.lit(1), F.greatest(F.lit(0), F.least(k, F.size(array)))))


def random_subset(array: Column, *seed: Column, allow_empty: bool = True) -> Column:
    """A subset whose size is drawn from 0 (or 1) to all, then its entries; sorted."""
    least = 0 if allow_empty else 1
    n = F.size(array) + (1 - least)
    k = F.when(n > 0, hash_draw([*seed, F.lit("size")], F.greatest(n, F.lit(1))).cast("int") + least).otherwise(0)
    return take_k(array, k, *seed)


def sample_prompts(df: DataFrame, prompts: list[str], k: int, *seed: str) -> DataFrame:
    """One row per row of df and sampled prompt, with prompt_id (0-based) and prompt. More than there are is an error."""
    if not 0 < k <= len(prompts):
        raise ValueError(f"{k} prompts asked of {len(prompts)}")
    picked = F.slice(shuffled(F.array(*[F.lit(p) for p in prompts]), *[F.col(c).cast("string") for c in seed]), 1, k)
    return df.select("*", F.posexplode(picked).alias("prompt_id", "prompt"))


def sample_options(targets: DataFrame, pool: DataFrame, quotas: list[tuple[str, str, Column]], item: str, exclude: str | None = None) -> DataFrame:
    """(item, option..., kind, letter): options drawn from a pool per item.

    targets: (item, coarse, source...). pool: (option_id, coarse, source...). quotas: (kind,
    relation, number) with relation ``same`` part, ``hard`` (same limb, other segment) or
    ``cross`` (other limb). exclude: a column both have; equal values are left out. Options
    of a quota are the first in md5(item:option) order, letters follow the same order.

    The join is on the related part, so an item meets all options of its parts: costs items x
    pool. ``draw_options`` draws from a pool of any size without that.
    """
    relation = [(c, "same", c) for c in dims.COARSE_PARTS] + [(c, "hard", x) for c in dims.COARSE_PARTS for x in dims.hard_negatives(c)] + [(c, "cross", x) for c in dims.COARSE_PARTS for x in dims.cross_limb(c)]
    spark = targets.sparkSession
    dim = spark.createDataFrame(relation, "coarse string, relation string, option_coarse string")
    joined = targets.join(F.broadcast(dim), "coarse").join(pool.withColumnRenamed("coarse", "option_coarse"), "option_coarse")  # dim: 16 rows
    if exclude:
        joined = joined.where(~F.col(exclude).eqNullSafe(F.col(f"option_{exclude}")))
    joined = joined.withColumn("_h", hash_order(F.col(item).cast("string"), F.col("option_id").cast("string")))
    place = F.row_number().over(Window.partitionBy(item, "relation").orderBy("_h", "option_id"))
    quota = F.lit(0)
    kind = F.lit(None).cast("string")
    for name, rel, n in quotas:
        quota = F.when(F.col("relation") == rel, n).otherwise(quota)
        kind = F.when(F.col("relation") == rel, name).otherwise(kind)
    kept = joined.withColumn("_p", place).where(F.col("_p") <= quota).withColumn("kind", kind)
    letter = F.char(F.row_number().over(Window.partitionBy(item).orderBy("_h", "option_id")) + 64)
    return kept.select(item, "option_id", "option_coarse", "kind", letter.alias("letter"))


def one_option_per_part(items: DataFrame, pool: DataFrame, item: str, exclude: str | None = None) -> DataFrame:
    """(item, option_id, option_coarse, letter): the first option of every part in md5 order, letters in md5 order."""
    joined = items.select(item, *([exclude] if exclude else [])).join(F.broadcast(items.sparkSession.createDataFrame([(c,) for c in dims.COARSE_PARTS], "option_coarse string"))).join(pool.withColumnRenamed("coarse", "option_coarse"), "option_coarse")
    if exclude:
        joined = joined.where(~F.col(exclude).eqNullSafe(F.col(f"option_{exclude}")))
    h = hash_order(F.col(item).cast("string"), F.col("option_id").cast("string"))
    best = joined.groupBy(item, "option_coarse").agg(F.min(F.struct(h.alias("h"), "option_id")).alias("b"))
    letter = F.char(F.row_number().over(Window.partitionBy(item).orderBy("b.h", "b.option_id")) + 64)
    return best.select(item, F.col("b.option_id").alias("option_id"), "option_coarse", letter.alias("letter"))


def numbered_pool(pool: DataFrame, source: str) -> DataFrame:
    """pool with its part as option_coarse and its place (0-based) in the part's list, where the options of a source lie together, in md5 order.

    The list is numbered in 256 pieces, by the first byte of the md5 of the source.
    """
    parts = pool.withColumnRenamed("coarse", "option_coarse").withColumn("_bucket", F.conv(F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int"))
    w = Window.partitionBy("option_coarse", "_bucket")
    within = F.row_number().over(w.orderBy(source, hash_order(F.col("option_id").cast("string")), "option_id")) - 1
    sizes = parts.groupBy("option_coarse", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("option_coarse").orderBy("_bucket")) - F.col("_n")
    starts = sizes.select("option_coarse", "_bucket", before.alias("_start"))
    return parts.withColumn("_p", within).join(F.broadcast(starts), ["option_coarse", "_bucket"]).withColumn("_place", F.col("_start") + F.col("_p")).drop("_bucket", "_start", "_p")  # starts: at most 256 rows a part


def distinct_draws(k: Column, n: Column, *seed: Column) -> Column:
    """least(k, n) different whole numbers in [0, n), every set equally likely (Floyd's algorithm; md5 of seed and step)."""
    m = F.least(k.cast("bigint"), n.cast("bigint"))
    steps = F.when(m > 0, F.sequence(n - m, n - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(found, j):
        h = F.conv(F.substring(F.md5(F.concat_ws(":", *seed, j.cast("string"))), 1, 15), 16, 10).cast("bigint")
        t = F.pmod(h, j + 1)
        return F.concat(found, F.array(F.when(F.array_contains(found, t), j).otherwise(t)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def _drawn(targets: DataFrame, pool: DataFrame, wanted, item: str, source: str) -> DataFrame:
    """(item, option_id, option_coarse, kind, letter) for wanted: array of (kind, k, parts) per target row.

    wanted: the array, from a function that gives the number of options an item may draw from of some parts.
    """
    numbered = numbered_pool(pool, source)
    sizes = numbered.groupBy("option_coarse").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("option_coarse", "n"))).alias("_sizes"))
    own = numbered.groupBy(F.col(source).alias("_source"), "option_coarse").agg(F.min("_place").alias("start"), F.count(F.lit(1)).alias("len"))
    own = own.groupBy("_source").agg(F.map_from_entries(F.collect_list(F.struct("option_coarse", F.struct("start", "len")))).alias("_own"))
    own_of = source.removeprefix("option_")
    placed = targets.join(own, F.col(own_of).eqNullSafe(F.col("_source")), "left").join(F.broadcast(sizes))  # sizes: one row, an entry per part
    # What an item may draw from: the lists of its parts one after another, without the stretch of its own source.
    span = lambda p: F.struct(
        p.alias("part"), F.coalesce(F.try_element_at("_own", p)["start"], F.lit(0)).alias("start"), F.coalesce(F.try_element_at("_own", p)["len"], F.lit(0)).alias("len"), F.coalesce(F.try_element_at("_sizes", p), F.lit(0)).alias("n")
    )
    available = lambda parts: F.aggregate(F.transform(parts, span), F.lit(0).cast("bigint"), lambda a, s: a + s["n"] - s["len"])
    asked = placed.select(F.col(item), "_own", "_sizes", F.explode(wanted(available)).alias("_w"))
    spans = F.transform("_w.parts", span)
    asked = asked.select(item, F.col("_w.kind").alias("kind"), F.col("_w.k").alias("_k"), spans.alias("_spans"))
    allowed = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["n"] - s["len"])
    drawn = asked.select(item, "kind", "_spans", F.explode(distinct_draws(F.col("_k"), allowed, F.col(item).cast("string"), F.col("kind"))).alias("_d"))

    def find(a, s):
        room = s["n"] - s["len"]
        here = a["part"].isNull() & (a["rest"] < room)
        place = F.when(a["rest"] < s["start"], a["rest"]).otherwise(a["rest"] + s["len"])
        return F.struct(
            F.when(a["part"].isNull() & ~here, a["rest"] - room).otherwise(a["rest"]).alias("rest"),
            F.when(here, s["part"]).otherwise(a["part"]).alias("part"), F.when(here, place).otherwise(a["place"]).alias("place"),
        )

    first = F.struct(F.col("_d").alias("rest"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("place"))
    found = drawn.select(item, "kind", F.aggregate("_spans", first, find).alias("_f"))
    options = found.select(item, "kind", F.col("_f.part").alias("option_coarse"), F.col("_f.place").alias("_place")).join(numbered.select("option_coarse", "_place", "option_id"), ["option_coarse", "_place"])
    letter = F.char(F.row_number().over(Window.partitionBy(item).orderBy(hash_order(F.col(item).cast("string"), F.col("option_id").cast("string")), "option_id")) + 64)
    return options.select(item, "option_id", "option_coarse", "kind", letter.alias("letter"))


def draw_options(targets: DataFrame, pool: DataFrame, quotas: list[tuple[str, str, int]], item: str, exclude: str) -> DataFrame:
    """As ``sample_options``, one target row per item, from a pool of any size: costs items x quota + pool.

    The options of a part are numbered; an item draws different numbers by md5 of item, kind
    and step among those its own source leaves, every set equally likely. So an item meets the
    options it draws only. Fewer allowed options than the quota are all drawn.
    """
    related = {"same": lambda c: [c], "hard": dims.hard_negatives, "cross": dims.cross_limb}
    each = lambda c: F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.array(*[F.lit(x) for x in related[rel](c)]).alias("parts")) for kind, rel, k in quotas])
    wanted = F.element_at(F.create_map(*[x for c in dims.COARSE_PARTS for x in (F.lit(c), each(c))]), F.col("coarse"))
    return _drawn(targets.where(F.col("coarse").isin(dims.COARSE_PARTS)), pool, lambda _: wanted, item, f"option_{exclude}")


def draw_variable(targets: DataFrame, pool: DataFrame, k: int, num_correct: str, hard_share: float, item: str, exclude: str) -> DataFrame:
    """As ``draw_options`` with a number of right options per target row, and k options in all.

    A share of the others (rounded down) are hard, the rest cross. What the pool lacks of one
    kind is made up by the next; only cross options can run short.
    """
    related = {"positive": lambda c: [c], "hard": dims.hard_negatives, "cross": dims.cross_limb}
    parts = {kind: F.element_at(F.create_map(*[x for c in dims.COARSE_PARTS for x in (F.lit(c), F.array(*[F.lit(p) for p in of(c)]))]), F.col("coarse")) for kind, of in related.items()}

    def wanted(available):
        right = F.least(F.col(num_correct).cast("bigint"), available(parts["positive"]))
        hard = F.least(F.floor((k - right) * F.lit(hard_share)), available(parts["hard"]))
        sizes = {"positive": right, "hard": hard, "cross": k - right - hard}
        return F.array(*[F.struct(F.lit(kind).alias("kind"), sizes[kind].alias("k"), parts[kind].alias("parts")) for kind in related])

    return _drawn(targets.where(F.col("coarse").isin(dims.COARSE_PARTS)), pool, wanted, item, f"option_{exclude}")


def draw_multi(targets: DataFrame, pool: DataFrame, k: int, parts: str, hard_share: float, item: str, exclude: str) -> DataFrame:
    """As ``draw_variable`` for items with several target parts (array column): one option of every target part, kind ``positive:<part>``.

    Hard options are of other segments of a target's limb, cross ones of the other limb; none of
    them is of a target part.
    """
    every = F.array(*[F.lit(c) for c in dims.COARSE_PARTS])
    limb = lambda p: F.split_part(p, F.lit("_"), F.lit(1))
    near = lambda p: F.exists(parts, lambda t: limb(t) == limb(p))
    hard = F.filter(every, lambda p: ~F.array_contains(parts, p) & near(p))
    cross = F.filter(every, lambda p: ~F.array_contains(parts, p) & ~near(p))

    def wanted(available):
        right = F.transform(parts, lambda p: F.struct(F.concat(F.lit("positive:"), p).alias("kind"), F.least(F.lit(1).cast("bigint"), available(F.array(p))).alias("k"), F.array(p).alias("parts")))
        found = F.aggregate(right, F.lit(0).cast("bigint"), lambda a, x: a + x["k"])
        n_hard = F.least(F.floor((k - found) * F.lit(hard_share)), available(hard))
        others = F.array(F.struct(F.lit("hard").alias("kind"), n_hard.alias("k"), hard.alias("parts")), F.struct(F.lit("cross").alias("kind"), (k - found - n_hard).alias("k"), cross.alias("parts")))
        return F.concat(right, others)

    return _drawn(targets, pool, wanted, item, f"option_{exclude}")


def drawn_num_correct(item: Column, zero_share: float, least: int, most: int) -> Column:
    """How many right options an item is to have: none for a share of the items, else a number in [max(1, least), most]."""
    low = max(1, least)
    none = hash_draw([item, F.lit("none")], F.lit(1_000_000)) < int(zero_share * 1_000_000)
    return F.when(none, 0).otherwise(low + hash_draw([item, F.lit("correct")], F.lit(most - low + 1))).cast("int")


def draw_one_per_part(items: DataFrame, pool: DataFrame, item: str, exclude: str) -> DataFrame:
    """As ``one_option_per_part`` from a pool of any size: one option of every part, drawn as in ``draw_options``."""
    wanted = F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(1).alias("k"), F.array(F.lit(c)).alias("parts")) for c in dims.COARSE_PARTS])
    return _drawn(items, pool, lambda _: wanted, item, f"option_{exclude}").drop("kind")


def other_orders(n: Column, limit: int = 8) -> Column:
    """How many orders n options have besides the given one; from ``limit`` options on as many as that many have."""
    enough = F.when(n <= 1, 0)
    factorial = 1
    for k in range(2, limit + 1):
        factorial *= k
        enough = enough.when(n == k, factorial - 1)
    return enough.otherwise(factorial)


NUMBERED = 18  # up to so many options the orders are numbered: 18! and the draws of 15 hex digits fit a bigint


def nth_order(n: Column, number: Column) -> Column:
    """The order of 0..n-1 with this number (0-based) in alphabetical order of orders; n at most ``NUMBERED``."""
    factorials = [1]
    for k in range(1, NUMBERED + 1):
        factorials.append(factorials[-1] * k)
    table = F.array(*[F.lit(f).cast("bigint") for f in factorials])
    start = F.struct(number.cast("bigint").alias("rest"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("int")).alias("left"), F.array().cast("array<int>").alias("out"))

    def take(a, _):
        f = F.get(table, F.size(a["left"]) - 1)
        d = ((a["rest"] - F.pmod(a["rest"], f)) / f).cast("int")
        return F.struct(
            F.pmod(a["rest"], f).alias("rest"),
            F.concat(F.slice(a["left"], F.lit(1), d), F.slice(a["left"], d + 2, F.size(a["left"]))).alias("left"),
            F.concat(a["out"], F.array(F.get(a["left"], d))).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, take, lambda a: a["out"])


def permuted_copies(items: DataFrame, item: str, options: str, copies: int, limit: int = 8) -> DataFrame:
    """Each item in ``copies`` other option orders, distinct and none the given one: (item, permutation_id, record_id, options).

    The letters stay with their options, so the gold set does not change. Items with too few
    options for that many orders are an error. Up to ``NUMBERED`` options the orders are
    numbered and that many different numbers drawn by md5 of the item, so exactly as many come
    out, also where nearly all orders are asked for. Beyond, orders are md5-shuffled under one
    seed after another; should two of so many orders be equal, that is an error.
    """
    n, key = F.size(options), F.col(item).cast("string")
    checked = items.withColumn("_ok", F.assert_true(other_orders(n, limit) >= copies, F.lit("too few options for that many orders")))
    factorial = F.lit(1).cast("bigint")
    product = 1
    for k in range(2, NUMBERED + 1):
        product *= k
        factorial = F.when(n == k, F.lit(product).cast("bigint")).otherwise(factorial)
    numbers = distinct_draws(F.lit(copies), factorial - 1, key, F.lit("shuffle"))
    places = lambda as_text: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string" if as_text else "int"))
    shuffles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(copies)), lambda s: F.transform(shuffled(places(True), key, s.cast("string")), lambda i: i.cast("int"))))
    many = F.slice(F.filter(shuffles, lambda p: p != places(False)), 1, copies)
    chosen = F.when(n <= NUMBERED, F.transform(numbers, lambda r: nth_order(F.least(n, F.lit(NUMBERED)), r + 1))).otherwise(many)
    out = checked.where("_ok is null").withColumn("_chosen", chosen)
    out = out.withColumn("_all", F.assert_true(F.size("_chosen") == copies, F.lit("two drawn orders are equal"))).where("_all is null")
    out = out.select(item, options, F.posexplode("_chosen").alias("permutation_id", "_order"))
    return out.select(item, "permutation_id", F.concat(key, F.lit("::shuffle"), F.col("permutation_id").cast("string")).alias("record_id"), F.transform("_order", lambda i: F.get(F.col(options), i)).alias("options"))


def shuffle_sensitivity(df: DataFrame, model: str, base: str, selected: str) -> DataFrame:
    """(model, num_items, selected_set_jaccard_mean, exact_std_mean, f1_std_mean) over the permutations of items.

    df: one row per model, base item and permutation, with exact and f1. Equal selections of an
    item are counted first, map-side; only its distinct selections are gathered (at most
    2^options, however many permutations there are) and compared, weighted by their counts.
    """
    x, y = F.col("exact"), F.col("f1")
    distinct = df.groupBy(model, base, F.array_sort(F.array_distinct(F.col(selected))).alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy")
    )
    items = distinct.groupBy(model, base).agg(F.sum("_c").alias("n"), *[F.sum(c).alias(c) for c in ("_x", "_xx", "_y", "_yy")], F.collect_list(F.struct("_s", "_c")).alias("s"))
    variance = lambda one, two: F.col(two) / F.col("n") - (F.col(one) / F.col("n")) ** 2
    spread = lambda one, two: F.when(variance(one, two) > 1e-13, F.sqrt(variance(one, two))).otherwise(0.0)  # noqa: E731  below lies only rounding
    places = F.sequence(F.lit(0), F.size("s") - 1)
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: L.jaccard(F.get("s", i)["_s"], F.get("s", j)["_s"]) * F.get("s", i)["_c"] * F.get("s", j)["_c"])))
    unlike = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
    alike = F.aggregate("s", F.lit(0.0), lambda a, v: a + v["_c"] * (v["_c"] - 1) / 2.0)
    mean = F.when(F.col("n") > 1, (unlike + alike) / (F.col("n") * (F.col("n") - 1) / 2.0)).otherwise(1.0)
    return items.select(model, mean.alias("j"), spread("_x", "_xx").alias("es"), spread("_y", "_yy").alias("fs")).groupBy(model).agg(
        F.count(F.lit(1)).alias("num_items"), F.avg("j").alias("selected_set_jaccard_mean"), F.avg("es").alias("exact_std_mean"), F.avg("fs").alias("f1_std_mean")
    )


def label_frequency(df: DataFrame, labels: str) -> DataFrame:
    """(label, n) over an array column."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


MAX_LABELS = 10_000  # labels of a vocabulary that is ranked whole


def top_labels(df: DataFrame, labels: str, k: int) -> list[str]:
    """The k most frequent labels, ties alphabetically."""
    return [r["label"] for r in label_frequency(df, labels).orderBy(F.desc("n"), "label").limit(k).collect()]


def ranked_labels(df: DataFrame, labels: str, limit: int = MAX_LABELS) -> list[str]:
    """All labels by falling frequency, then alphabetically; a vocabulary of more than ``limit`` is an error."""
    ranked = top_labels(df, labels, limit + 1)
    if len(ranked) > limit:
        raise ValueError(f"more than {limit} labels")
    return ranked


def modal_size(df: DataFrame, labels: str) -> int:
    """Most frequent set size, the smallest on ties, 0 if there is none."""
    return df.agg(F.mode(F.size(labels), True).alias("k")).first()["k"] or 0


BASELINES = ["random", "label_freq_prior", "answer_count_prior", "always_none", "top_k_frequent"]


def baseline_predictions(items: DataFrame, item: str, gold: str, space: str, baseline: str, seed: int = 0, k: int = 2) -> DataFrame:
    """items with a column pred of one control baseline.

    space: array of labels an item may be answered with. random: a random subset.
    label_freq_prior: the most frequent gold labels the item allows, as many as gold sets
    usually have. answer_count_prior: that many random labels. always_none: nothing.
    top_k_frequent: the k most frequent gold labels, allowed or not.
    """
    key = [F.lit(str(seed)), F.col(item).cast("string")]
    if baseline == "random":
        pred = random_subset(F.col(space), *key)
    elif baseline == "label_freq_prior":
        ranked, n = ranked_labels(items, gold), modal_size(items, gold)
        pred = L.as_set(F.slice(L.ordered_labels(F.col(space), ranked), 1, n)) if ranked and n else L.empty()
    elif baseline == "answer_count_prior":
        pred = take_k(F.col(space), F.lit(modal_size(items, gold)), *key)
    elif baseline == "always_none":
        pred = L.empty()
    elif baseline == "top_k_frequent":
        pred = L.as_set(F.array(*[F.lit(x) for x in top_labels(items, gold, k)]).cast("array<string>"))
    else:
        raise ValueError(f"unknown baseline: {baseline}")
    return items.withColumn("pred", pred)
