"""Ranks, correlations, task coupling, bootstrap and interval estimates as aggregations."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeloom.functions import labels as L
from gaugeloom.functions.md5 import numbered
from gaugeloom.runtime import shuffle_partitions

RANGES = 256  # ranges of values that prefix sums and pair counts are split into


def value_ranges(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """One row with the bounds of ranges of about as many rows each (approximate quantiles)."""
    return df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000).alias("_bounds"))


def range_of(value: Column, bounds: Column) -> Column:
    """Number of a value's range. A value that is a bound has a range of its own, so that one shared by many rows lies alone."""
    return 2 * F.size(F.filter(bounds, lambda b: b < value)) + F.exists(bounds, lambda b: b == value).cast("int")


def sums_below(df: DataFrame, value: str, n: str, by: list[str] = (), name: str = "_below") -> DataFrame:
    """Adds the sum of n over the smaller values (per ``by``); values are distinct there.

    Values are cut into ranges; sums of whole ranges come from one row per range, and only
    rows of a range are sorted together. So no task sorts all values. Nulls come first.
    """
    bounds = value_ranges(df, value)
    placed = df.join(F.broadcast(bounds)).withColumn("_range", F.coalesce(range_of(F.col(value), F.col("_bounds")), F.lit(-1))).drop("_bounds")  # one row of bounds
    totals = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_t"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = totals.withColumn("_before", F.sum("_t").over(w.orderBy("_range")) - F.col("_t")).drop("_t")  # a row per range
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = placed.withColumn("_inside", inside)
    on = F.col("l._range") == F.col("r._range")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return located.alias("l").join(before.alias("r"), on).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._inside")).alias(name))


def average_rank(df: DataFrame, value: str, by: list[str] = (), name: str = "rank") -> DataFrame:
    """Rank with ties shared, of numbers or instants. Equal values are counted map-side first, and ranked range by range."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sums_below(counts, value, "_n", by).select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    right = ranks.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, value)], name)
    on = None
    for c in (*by, value):
        same = df[c].eqNullSafe(right[f"_k_{c}"])
        on = same if on is None else on & same
    return df.join(right, on).select(*df.columns, name)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r; 0 for fewer than two rows or no variance."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): Pearson's r of average ranks."""
    ranked = average_rank(average_rank(df, x, name="_rx"), y, name="_ry")
    return ranked.agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign(x_i - x_j) sign(y_i - y_j) over pairs of distinct (x, y), by merging: n log n steps in numpy."""
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(np.float64)
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    n, width = len(x), int(y.max()) + 2 if len(x) else 1
    total, half, at = 0.0, 1, np.arange(n)
    while half < n:
        block, right = at // (2 * half), (at // half) % 2 == 1
        key = block * width + y
        left = np.flatnonzero(~right)
        left = left[np.argsort(key[left], kind="stable")]
        keys, sums = key[left], np.concatenate(([0.0], np.cumsum(w[left])))
        k, b = key[right], block[right]
        less = sums[np.searchsorted(keys, k, "left")] - sums[np.searchsorted(keys, b * width, "left")]
        more = sums[np.searchsorted(keys, (b + 1) * width, "left")] - sums[np.searchsorted(keys, k, "right")]
        total += float(np.sum(w[right] * (less - more)))
        half *= 2
    # Pairs of equal x stand in order of y and were counted as rising.
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if n else np.array([], int)
    if n:
        whole, squares = np.add.reduceat(w, starts), np.add.reduceat(w * w, starts)
        total -= float(np.sum(whole * whole - squares) / 2)
    return total


def kendall_tau_b(df: DataFrame, x: str, y: str, ranges: int = RANGES) -> DataFrame:
    """(kendall_tau_b) with tie correction, 0 if undefined, over any number of rows; rows with a null are left out.

    Equal pairs are counted first. x and y are cut into ranges: pairs of rows in different
    ranges of both are told by the counts of the range grid, pairs in one range of x are
    counted there, and pairs in one range of y but not of x there. A value shared by many rows
    has a range of its own, within which all pairs are tied, so it is not gathered.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    bounds = value_ranges(rows, "x", ranges).select(F.col("_bounds").alias("_bx")).join(F.broadcast(value_ranges(rows, "y", ranges).select(F.col("_bounds").alias("_by"))))
    placed = rows.join(F.broadcast(bounds)).select("x", "y", "w", range_of(F.col("x"), F.col("_bx")).alias("a"), range_of(F.col("y"), F.col("_by")).alias("b"))  # one row of bounds
    schema = "s double"

    def within(one: str, other: str):
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [concordance(pdf[one].to_numpy(), pdf[other].to_numpy(), pdf["w"].to_numpy())]})

        return count

    of_x = placed.where("a % 2 = 0").groupBy("a").applyInPandas(within("x", "y"), schema)
    cells = placed.where("b % 2 = 0").groupBy("b", "a", "y").agg(F.sum("w").alias("w"))
    of_y = cells.groupBy("b").applyInPandas(within("a", "y"), schema)
    grid = placed.groupBy("a", "b").agg(F.sum("w").alias("w")).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(within("a", "b"), schema)  # at most (2 ranges)^2 rows
    s = of_x.unionByName(of_y).unionByName(grid).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    tied = lambda k, name: rows.groupBy(k).agg(F.sum("w").alias("w")).agg(pairs("w").alias(name))
    n0 = rows.agg(F.sum("w").alias("w")).agg(pairs("w").alias("n0"))
    both = s.join(F.broadcast(n0)).join(F.broadcast(tied("x", "n1"))).join(F.broadcast(tied("y", "n2")))  # single rows
    return both.select(L.ratio(F.col("s"), F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))).alias("kendall_tau_b"))


def two_by_two(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n, both_correct, a_correct_b_wrong, a_wrong_b_correct, both_wrong) of two (key, correct) tables."""
    j = a.select(key, F.col("correct").alias("a")).join(b.select(key, F.col("correct").alias("b")), key)
    x, y = F.col("a"), F.col("b")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_correct"), F.count_if(x & ~y).alias("a_correct_b_wrong"), F.count_if(~x & y).alias("a_wrong_b_correct"), F.count_if(~x & ~y).alias("both_wrong")
    )


def coupling(counts: DataFrame) -> DataFrame:
    """Adds phi, mutual information in bits, and P(b wrong | a wrong) (null if a is never wrong)."""
    a, b, c, d = (F.col(k).cast("double") for k in ("both_correct", "a_correct_b_wrong", "a_wrong_b_correct", "both_wrong"))
    n = a + b + c + d
    phi = L.ratio(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))
    term = lambda x, r, s: F.when(x > 0, x / n * F.log2(x * n / (r * s))).otherwise(0.0)
    mi = term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d)
    return counts.withColumns({"phi": phi, "mutual_info_bits": mi, "p_b_wrong_given_a_wrong": F.try_divide(d, c + d)})


def task_pairs(long: DataFrame, key: str) -> DataFrame:
    """(task_a, task_b, 2x2 counts) of every unordered pair of tasks in (task, key, correct).

    The tasks of a key are gathered (a few per key), not joined with each other.
    """
    per_key = long.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("task", "correct"))).alias("t"))
    pairs = per_key.select("t", F.posexplode("t").alias("i", "a")).select("a", F.explode(F.expr("slice(t, i + 2, greatest(0, size(t) - i - 1))")).alias("b")).where("a.task <> b.task")
    x, y = F.col("a.correct"), F.col("b.correct")
    return pairs.groupBy(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_correct"), F.count_if(x & ~y).alias("a_correct_b_wrong"), F.count_if(~x & y).alias("a_wrong_b_correct"), F.count_if(~x & ~y).alias("both_wrong")
    )


def task_matrix(long: DataFrame, key: str) -> DataFrame:
    """(task_a, task_b, n, both_wrong, p_b_wrong_given_a_wrong) of every ordered pair of tasks in (task, key, correct), with the diagonal.

    The diagonal is 1 where a task has keys. Tasks of a key are gathered (a few per key).
    """
    per_key = long.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("task", "correct"))).alias("t"))
    pairs = per_key.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b"))
    x, y = F.col("a.correct"), F.col("b.correct")
    counts = pairs.groupBy(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~x & ~y).alias("both_wrong"), F.count_if(~x).alias("_wrong"))
    share = F.when(F.col("task_a") == F.col("task_b"), 1.0).otherwise(F.try_divide("both_wrong", "_wrong"))
    return counts.withColumn("p_b_wrong_given_a_wrong", share).drop("_wrong")


def coupling_report(long: DataFrame, key: str) -> DataFrame:
    """task_matrix with phi and mutual information of the pairs (null on the diagonal): the report on two, three or more tasks."""
    measures = coupling(task_pairs(long, key)).select("task_a", "task_b", "phi", "mutual_info_bits")
    both = measures.unionByName(measures.select(F.col("task_b").alias("task_a"), F.col("task_a").alias("task_b"), "phi", "mutual_info_bits"))
    return task_matrix(long, key).join(F.broadcast(both), ["task_a", "task_b"], "left")  # a row per pair of tasks


def ranking_agreement(scores: DataFrame, x: str, y: str) -> DataFrame:
    """(n_models, spearman, kendall_tau_b) of two scores per model; null correlations under three models."""
    both = scores.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = both.agg(F.count(F.lit(1)).alias("n_models"))
    told = n.join(F.broadcast(spearman(both, x, y))).join(F.broadcast(kendall_tau_b(both, x, y)))  # single rows
    enough = F.col("n_models") >= 3
    return told.select("n_models", F.when(enough, F.col("spearman")).alias("spearman"), F.when(enough, F.col("kendall_tau_b")).alias("kendall_tau_b"))


def hash_draw(parts: list[Column], n: Column) -> Column:
    """A whole number in [0, n) that depends on the parts alone: md5, so other engines draw the same."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n)


def hash_order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def md5_part(k: Column, *parts: Column) -> Column:
    """A whole number in [0, 2^32): the k-th of the four that an md5 of the parts holds."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), k * 8 + 1, F.lit(8)), 16, 10).cast("long")


def _replicates(rows: DataFrame, key: Column, replicates: int, name: str) -> DataFrame:
    """Each row with each replicate rep and a whole number in [0, 2^32) as ``name``; four replicates share the md5 of (rep / 4, key)."""
    seeded = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))).alias("_q")).withColumn("_h", F.md5(F.concat_ws(":", F.col("_q").cast("string"), key.cast("string"))))
    number = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long")
    four = F.array(*[F.struct((F.col("_q") * 4 + k).alias("rep"), number(k).alias(name)) for k in range(4)])
    return seeded.select(*rows.columns, F.inline(four)).where(F.col("rep") < replicates)


SLOTS = 65_536  # slots that draw together, at most
RUNS = 32  # runs of slots at least, so that small tables keep all cores busy
TABLE = 2_000_000  # distinct rows that a task looks places up in
BUCKETS = 16_384  # of equal width, by which most places are looked up


def bootstrap_sums(df: DataFrame, sums: list[str], by: list[str] = (), replicates: int = 1000, weight: str | None = None) -> DataFrame:
    """(by, rep, n, sums...): sums of columns over resampled rows, one row per replicate, drawn row by row.

    Equal rows are counted first and then take a range of places each; every place is also a
    slot that draws, per replicate, a place by md5 of (replicate, slot), so that other engines
    draw the same. Costs replicates x rows: ``multinomial_bootstrap_sums`` draws from the same
    distribution at replicates x distinct rows. A task draws for a run of slots and looks the
    places up in the distinct rows itself, so that only sums per replicate leave it. Of more
    than ``TABLE`` distinct rows, tasks hold those of as many places at most, and every such part is
    drawn for by all slots. Decimals are summed as doubles.

    weight: how often each row of df is there; else once.
    """
    values = df.groupBy(*by, *sums).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    # Places in order of the sums: those of smaller first sums by ranges, those of equal first sums within them.
    first, rest = sums[0], [F.col(c) for c in sums[1:]]
    below = sums_below(values.groupBy(*by, first).agg(F.sum("_n").alias("_t")), first, "_t", by)
    keys = [*by, first]
    right = below.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_below")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(*(rest or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = values.withColumn("_in", inside).join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])).withColumn("_from", F.col("_below") + F.col("_in"))
    totals = values.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    if by:
        totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_all", "_rows")
        located = located.join(totals, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]))
    else:
        located = located.join(F.broadcast(totals))  # one row
    # Every run of slots gets the distinct rows, or each part of them. A run is no shorter than these are many, so a part is repeated to no more rows than there are places.
    whole = [isinstance(df.schema[c].dataType, T.IntegralType) for c in sums]
    located = located.withColumns({"_part": F.when(F.col("_rows") <= TABLE, F.lit(0)).otherwise(F.floor(F.col("_from") / TABLE)).cast("bigint"), "_run": F.greatest(F.least(F.lit(SLOTS), F.ceil(F.col("_all") / RUNS)), F.least("_rows", F.lit(TABLE))).cast("bigint")})
    numbers = [F.coalesce(F.col(c).cast("bigint" if w else "double"), F.lit(0)).alias(f"_v{j}") for j, (c, w) in enumerate(zip(sums, whole))]
    repeated = located.select(*by, "_all", "_part", "_run", "_from", "_n", *numbers, *[F.col(c).isNotNull().cast("bigint").alias(f"_p{j}") for j, c in enumerate(sums)], F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_all") - 1) / F.col("_run")))).alias("_at"))
    session = df.sparkSession
    tasks = 4 * max(shuffle_partitions(session), session.sparkContext.defaultParallelism)
    counts = ["n", *[f"_p{j}" for j in range(len(sums))]]
    names = [[*counts, *[f"_v{j}" for j, w in enumerate(whole) if w]], [f"_v{j}" for j, w in enumerate(whole) if not w]]
    fields = [T.StructField(c, df.schema[c].dataType) for c in by] + [T.StructField("rep", T.IntegerType())] + [T.StructField(c, kind()) for cs, kind in zip(names, (T.LongType, T.DoubleType)) for c in cs]

    def draw(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_from")
        held = {c: rows.column(c).to_numpy() for c in rows.column_names if c[0] == "_"} | {"n": np.ones(rows.num_rows, np.int64)}
        n, run, at = (int(held[c][0]) for c in ("_all", "_run", "_at"))
        drawn = place_sums(held["_from"], int(held["_from"][-1] + held["_n"][-1]), [[held[c] for c in cs] for cs in names], n, at * run, min(n, (at + 1) * run), replicates)
        columns = [rows.column(c).take(pa.array([0] * replicates)) for c in by] + [pa.array(range(replicates), pa.int32())]
        for sums_of, kind in zip(drawn, (pa.int64(), pa.float64())):
            columns += [pa.array(sums_of[:, j].tolist(), kind) for j in range(sums_of.shape[1])]
        return pa.table(columns, [f.name for f in fields])

    drawn = repeated.repartition(tasks, *by, "_part", "_at").groupBy(*by, "_part", "_at").applyInArrow(draw, T.StructType(fields))
    return drawn.groupBy(*by, "rep").agg(F.sum("n").alias("n"), *[F.when(F.sum(f"_p{j}") > 0, F.sum(f"_v{j}")).alias(c) for j, c in enumerate(sums)])


def place_sums(starts: np.ndarray, end: int, columns: list[list[np.ndarray]], n: int, first: int, last: int, replicates: int) -> list[np.ndarray]:
    """Per replicate, the sums of columns over the rows whose places the slots from first to last - 1 draw, of n places.

    A row's places begin at its entry in starts, which rise, and go up to the next row's, at last to end; other places count nothing.
    columns: lists of columns of whole numbers and of doubles; each gives an array of replicates x its columns.
    """
    limits = np.concatenate(([0], starts, [end]))
    tables = []
    for cs, kind in zip(columns, (np.int64, np.float64)):
        t = np.zeros((len(limits), len(cs)), kind)
        for j, c in enumerate(cs):
            t[1:-1, j] = c
        if kind is np.int64 and max(int(t.max()), -int(t.min())) * (last - first) >= 1 << 63:
            t = t.astype(object)
        tables.append(t)
    totals = [np.zeros((replicates, t.shape[1]), t.dtype) for t in tables]
    # The numbers drawn are below 2^32. A place whose bucket lies within one row's places is looked up there, another by search.
    width = max(0, (min(n, 1 << 32) - 1).bit_length() - (BUCKETS - 1).bit_length())
    edges = np.arange(((min(n, 1 << 32) - 1) >> width) + 1, dtype=np.int64) << width
    row = np.searchsorted(limits, edges, "right") - 1
    row[row != np.searchsorted(limits, edges + ((1 << width) - 1), "right") - 1] = -1
    for start in range(first, last, SLOTS):
        for prefixes, parts in numbered([f"{q}:" for q in range((replicates + 3) // 4)], start, min(last, start + SLOTS)):
            for k, places in enumerate(parts):
                if n < 1 << 32:
                    places -= places // np.uint32(n) * np.uint32(n)
                found = row.take(places.ravel() >> np.uint32(width))
                mixed = np.flatnonzero(found < 0)
                found[mixed] = np.searchsorted(limits, places.ravel()[mixed].astype(np.int64), "right") - 1
                for prefix, drawn in zip(prefixes, found.reshape(places.shape)):
                    if (rep := 4 * int(prefix[:-1]) + k) >= replicates:
                        break
                    if len(limits) <= len(drawn):
                        times = np.bincount(drawn, minlength=len(limits))
                        drawn = np.flatnonzero(times)
                        for t, total in zip(tables, totals):
                            total[rep] += times[drawn] @ t[drawn]
                    else:
                        for t, total in zip(tables, totals):
                            total[rep] += t[drawn].sum(0)
    return totals


CELLS = 1024  # cells that distinct rows are hashed into, each drawn from on its own


def multinomial_bootstrap_sums(df: DataFrame, sums: list[str], by: list[str] = (), replicates: int = 1000, seed: int = 42, cells: int = CELLS) -> DataFrame:
    """As ``bootstrap_sums`` from the same distribution, at any size: costs replicates x distinct rows.

    How often each distinct row is drawn is multinomial, drawn by halving: how many of the draws
    fall to the first half of the cells of distinct rows, and so on down to the cell, each half
    by a binomial number whose seed is the place in the tree, so that all tasks draw the same;
    then row by row within the cell. Only sums per replicate and cell leave a task. Nulls count as 0.
    """
    values = df.select(*by, *[F.coalesce(F.col(s), F.lit(0)).cast("double").alias(s) for s in sums]).groupBy(*by, *sums).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_cell", F.pmod(F.xxhash64(*sums), F.lit(cells)).cast("int"))
    group = F.xxhash64(*by, F.lit(seed)) if by else F.lit(seed).cast("bigint")
    per_cell = values.groupBy(*by, "_cell").agg(F.sum("_n").alias("_c"))
    sizes = per_cell.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_cell", "_c"))).alias("_sizes")).withColumn("_seed", group)  # at most ``cells`` entries
    if by:
        joined = values.join(sizes.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_sizes", "_seed"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])).drop(*[f"_g_{c}" for c in by])
    else:
        joined = values.join(F.broadcast(sizes))  # one row
    fields = [df.select(*by).schema[c] for c in by] + [T.StructField("rep", T.IntegerType()), T.StructField("_k", T.LongType())] + [T.StructField(f"_s_{s}", T.DoubleType()) for s in sums]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        names = [int(x["_cell"]) for x in first["_sizes"]]
        size = np.array([int(x["_c"]) for x in first["_sizes"]], dtype=np.float64)
        mine, low, high = names.index(int(first["_cell"])), 0, len(names)
        counts, table = pdf["_n"].to_numpy(np.float64), pdf[list(sums)].to_numpy(np.float64)
        source = lambda place: np.random.Generator(np.random.Philox(key=[int(first["_seed"]) & ((1 << 64) - 1), place]))
        k = np.full(replicates, int(size.sum()), dtype=np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            lower = source(low << 32 | high).binomial(k, size[low:middle].sum() / size[low:high].sum())
            k, low, high = (lower, low, middle) if mine < middle else (k - lower, middle, high)
        own = source(1 << 63 | mine)
        order = np.lexsort(table.T[::-1]) if len(sums) else np.arange(len(pdf))
        counts, table = counts[order], table[order]
        left, rest, out = k.astype(np.int64), counts.sum(), np.zeros((replicates, len(sums)))
        for i in range(len(counts)):
            taken = left if i == len(counts) - 1 else own.binomial(left, min(1.0, counts[i] / rest))
            out += taken[:, None] * table[i]
            left, rest = left - taken, rest - counts[i]
        part = {c: [first[c]] * replicates for c in by}
        part.update({"rep": np.arange(replicates, dtype=np.int32), "_k": k.astype(np.int64)})
        part.update({f"_s_{s}": out[:, j] for j, s in enumerate(sums)})
        return pd.DataFrame(part)

    drawn = joined.groupBy(*by, "_cell").applyInPandas(draw, T.StructType(fields))
    return drawn.groupBy(*by, "rep").agg(F.sum("_k").alias("n"), *[F.sum(f"_s_{s}").alias(s) for s in sums])


def poisson_bootstrap_sums(df: DataFrame, sums: list[str], id_column: str, by: list[str] = (), replicates: int = 1000) -> DataFrame:
    """As ``bootstrap_sums`` with a Poisson(1) weight per row and replicate, by md5 of (replicate, id): one pass, map-side sums, rows stay where they are."""
    p, total, weight = math.exp(-1), 0.0, F.lit(12)
    steps = []
    for k in range(12):
        total += p
        steps.append((k, math.floor(total * (1 << 32))))
        p /= k + 1
    for k, t in reversed(steps):
        weight = F.when(F.col("_r") < t, k).otherwise(weight)
    rows = _replicates(df.select(*by, id_column, *sums), F.col(id_column), replicates, "_r").withColumn("_w", weight)
    return rows.groupBy(*by, "rep").agg(F.sum("_w").alias("n"), *[F.sum(F.col(s) * F.col("_w")).alias(s) for s in sums])


def interval(df: DataFrame, value: str, by: list[str] = (), confidence: float = 0.95) -> DataFrame:
    """(std, ci_lower, ci_upper) of replicates: sample deviation and exact, linear percentiles."""
    tail = (1 - confidence) / 2
    q = F.percentile(F.col(value), F.array(F.lit(tail), F.lit(1 - tail)))
    return df.groupBy(*by).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("_q")).select(*by, "std", F.get("_q", F.lit(0)).alias("ci_lower"), F.get("_q", F.lit(1)).alias("ci_upper"))


def moments(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(n, mean, std): sample deviation, 0 for one value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 1000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(q: float, df: float) -> float:
    """Quantile of Student's t, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < max(q, 1 - q) else (low, mid)
    return low if q >= 0.5 else -low


def confidence_interval(df: DataFrame, value: str, by: list[str], confidence: float = 0.95) -> DataFrame:
    """(n, mean, std, ci_lower, ci_upper) with Student's t; one value is its own interval. Quantiles are taken per group, in Arrow batches."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: t_quantile(0.5 + confidence / 2, k - 1) if k > 1 else 0.0 for k in n.unique()}
        return n.map(known).astype("float64")

    half = F.col("std") / F.sqrt(F.col("n").cast("double")) * quantile(F.col("n"))
    return moments(df, value, by).withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})


def metrics_by_run(runs: DataFrame, by: list[str] = (), metrics: list[str] | None = None) -> DataFrame:
    """(by, metric, n, mean, std, ci_lower, ci_upper) of every metric column over its runs, nulls left out.

    metrics: by default all number columns that are not in by and do not begin with ``_``.
    """
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    names = metrics or [f.name for f in runs.schema.fields if isinstance(f.dataType, numbers) and f.name not in by and not f.name.startswith("_")]
    long = runs.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("x")).select(*by, "x.metric", "x.v").where("v is not null")
    return confidence_interval(long, "v", [*by, "metric"])


def welch_tests(df: DataFrame, model: str, value: str, level: float = 0.05, limit: int = 2000) -> DataFrame:
    """(model_a, model_b, t, df, p, significant) of every pair of models with two values or more.

    Only moments per model are paired; more than ``limit`` models are an error.
    """
    m = moments(df, value, [model]).where("n >= 2")
    n = m.count()
    if n > limit:
        raise ValueError(f"{n} models; all pairs are compared, of at most {limit}")
    rows = m.agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("model"), "n", "mean", "std"))).alias("m"))
    pairs = rows.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, greatest(0, size(m) - i - 1))")).alias("b"))
    va, vb = F.col("a.std") ** 2 / F.col("a.n"), F.col("b.std") ** 2 / F.col("b.n")
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb))
    free = F.try_divide((va + vb) ** 2, va**2 / (F.col("a.n") - 1) + vb**2 / (F.col("b.n") - 1))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k) if x == x and k == k else None for x, k in zip(t, d)], dtype="float64")

    out = pairs.select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), t.alias("t"), free.alias("df"))
    return out.withColumn("p", p_value("t", "df")).withColumn("significant", F.col("p") < level)
