"""Sources mixed to target shares of the total size in tokens, within repeat limits."""

from __future__ import annotations

import base64
import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeloom.runtime import bounded, per_worker, spread, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1024  # buckets of the order in which texts of a source are taken
MAX_SOURCES = 10_000


def load_tokenizer(path: str):
    """The byte-level tokenizer of a vocabulary file, which every executor must have at this path."""
    import tiktoken

    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer vocabulary at {path}: give its path, the same on all executors")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, digest, n_tokens): size of each whole text; the text itself goes no further."""
    schema = "doc_id bigint, source string, digest binary, n_tokens bigint"

    def count(batches):
        tokenizer = per_worker(("tokenizer", path), lambda: load_tokenizer(path))
        for b in batches:
            n = [len(tokenizer.encode_ordinary(t.encode("utf-8", "replace").decode())) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "digest", "n_tokens"])

    known = documents.where("text is not null and source is not null")
    return known.select(F.col("doc_id").cast("bigint"), "source", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "text").mapInArrow(count, schema)


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def tempered(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Shares between the natural (exponent 0) and the target ones (exponent 1), each a power of both."""
    w = [t**exponent * n ** (1 - exponent) if n > 0 and t > 0 else 0.0 for n, t in zip(natural, target)]
    return [x / sum(w) for x in w] if sum(w) else w


def solve_weights(tokens: list[int], target: list[float], limits: list[int], total: float | None = None, least_entropy: float | None = None) -> tuple[list[float], float, float]:
    """(shares, total size, exponent) for sources of so many tokens, target shares and repeat limits.

    Without a total, it is the greatest size at which the target shares keep every limit, and
    the exponent is 1. With a greater total, the exponent is bisected: the largest one, that is
    the shares nearest the target, whose repeats keep every limit (and whose entropy is at
    least least_entropy, if given). If no exponent does, the natural shares (exponent 0) are
    taken, and the total falls to what the limits allow.
    """
    size = sum(tokens)
    if not size:
        return [0.0] * len(tokens), 0.0, 1.0
    natural = [n / size for n in tokens]

    def most(shares):
        return min((limit * n / s for n, s, limit in zip(tokens, shares, limits) if s > 0), default=0.0)

    full = tempered(natural, target, 1.0)
    if total is None:
        total = most(full)

    def keeps(a):
        shares = tempered(natural, target, a)
        return most(shares) >= total * (1 - 1e-12) and (least_entropy is None or entropy(shares) >= least_entropy)

    if keeps(1.0):
        return full, total, 1.0
    low, high = 0.0, 1.0
    if not keeps(low):
        # Shares between may still keep the limits: look for one on a grid before giving up.
        low = max((k / 64 for k in range(65) if keeps(k / 64)), default=0.0)
        if low == 0.0:
            shares = tempered(natural, target, 0.0)
            return shares, min(total, most(shares)), 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if keeps(middle) else (low, middle)
    return tempered(natural, target, low), total, low


def temper(tokens: list[int], limits: list[int], total: float | None, wanted_entropy: float) -> tuple[list[float], float, float]:
    """(shares, total size, exponent) by temperature alone: each share is a power of the source's natural share.

    The exponent is bisected until the shares have the wanted entropy (it falls as the exponent
    rises from 0, equal shares, over 1, natural shares). Without a total, it is what the limits
    allow at these shares. Where a given total would repeat a source beyond its limit, the
    exponent is bisected on towards 1, to the one nearest the first that keeps all limits; if
    none does, the total falls to what the limits allow.
    """
    size = sum(tokens)
    if not size:
        return [0.0] * len(tokens), 0.0, 1.0
    logs = [math.log(n / size) if n else None for n in tokens]

    def shares(a):
        top = max(a * x for x in logs if x is not None)
        w = [math.exp(a * x - top) if x is not None else 0.0 for x in logs]
        return [x / sum(w) for x in w]

    def bisect(low, high, keeps_low):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if keeps_low(shares(middle)) else (low, middle)
        return low, high

    def most(s):
        return min((limit * n / x for n, x, limit in zip(tokens, s, limits) if x > 0), default=0.0)

    a = bisect(0.0, 64.0, lambda s: entropy(s) >= wanted_entropy)[0]
    if total is None:
        return shares(a), most(shares(a)), a
    fits = lambda s: most(s) >= total * (1 - 1e-12)
    if not fits(shares(a)) and fits(shares(1.0)):
        a = bisect(a, 1.0, lambda s: not fits(s))[1]
    found = shares(a)
    return found, min(total, most(found)), a


class Mixture:
    """A mixture of documents' sources: its plan per source, and the texts chosen.

    Texts without source, of a source without target, or null are left out. Texts repeated
    under other doc_ids in a source are one text there, with the smallest doc_id: max_repeats
    limits how often a text is used. Sources without texts get nothing and the other targets
    are scaled up. Each source gives whole passes over its texts, and a last partial pass in a
    fixed pseudo-random order up to its budget (to the nearest text). Repeated targets: the
    first by (share, limit) counts. Null shares or limits count as 0 and 1. Empty tables give
    an empty result. Texts of zero tokens are part of whole passes only.

    by_temperature: shares are powers of the natural shares alone, with the entropy of the target
    shares (or least_entropy), see ``temper``; the total is what the repeat limits allow, if not given.

    Token counts are written once to the shared folder and read three times. Only a few
    numbers per source come to the driver. The cut of the last pass is found in sums over
    hash buckets, and within the bucket that is cut again, so that of a source only one in
    buckets^2 parts is sorted.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, total: float | None = None, least_entropy: float | None = None, seed: int = 42, buckets: int = BUCKETS, by_temperature: bool = False):
        spark = documents.sparkSession
        wanted = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("x"))
        listed = bounded(wanted.select("source", "x.s", "x.r").orderBy("source"), MAX_SOURCES)
        named = spark.createDataFrame([(r["source"],) for r in listed], "source string")
        known = spread(documents.select("doc_id", "source", "text").where("text is not null and source is not null"), "doc_id")
        chosen = known.join(F.broadcast(named), "source", "left_semi")  # at most MAX_SOURCES names
        texts = with_tokens(chosen, path).groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"))
        place = F.xxhash64("digest", F.lit(seed))
        again = F.pmod(F.xxhash64("digest", F.lit(seed), F.lit(2)), F.lit(buckets)).cast("int")
        self.texts = written(texts.select("source", "doc_id", "n_tokens", place.alias("place"), F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), again.alias("inner")))

        sizes = {r["source"]: r["n"] for r in self.texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        tokens = [sizes.get(r["source"], 0) for r in listed]
        targets_of, limits = [r["s"] for r in listed], [r["r"] for r in listed]
        if by_temperature:
            whole = sum(t for t, n in zip(targets_of, tokens) if n) or 1.0
            wanted_entropy = entropy([t / whole for t, n in zip(targets_of, tokens) if n]) if least_entropy is None else least_entropy
            shares, self.total, self.exponent = temper(tokens, limits, total, wanted_entropy)
        else:
            shares, self.total, self.exponent = solve_weights(tokens, targets_of, limits, total, least_entropy)
        plan = []
        for r, n, share in zip(listed, tokens, shares):
            budget = share * self.total
            passes = min(int(budget / n + 1e-9), r["r"]) if n else 0
            rest = max(0.0, budget - passes * n) if passes < r["r"] else 0.0
            plan.append((r["source"], float(r["s"]), int(r["r"]), n, float(share), float(budget), passes, rest))
        schema = "source string, target_share double, max_repeats int, available bigint, weight double, budget double, passes int, rest double"
        self.plan = spark.createDataFrame(plan, schema)
        self.rests = {p[0]: p[7] for p in plan}

    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies) of every text that is used."""
        spark = self.texts.sparkSession
        rests = spark.createDataFrame([(s, float(r)) for s, r in self.rests.items()] or [], "source string, rest double")

        def cut_of(rows: DataFrame, level: str, rests: DataFrame) -> dict:
            """source -> (bucket in which the rest ends, tokens before it), of buckets of this level."""
            sums = rows.groupBy("source", level).agg(F.sum("n_tokens").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("source").orderBy(level))  # one row per bucket
            cuts = sums.select("source", level, "n", upto.alias("upto")).join(F.broadcast(rests), "source").where("upto > rest and upto - n <= rest")  # one row per source
            found = cuts.groupBy("source").agg(F.min(F.struct(F.col(level).alias("b"), (F.col("upto") - F.col("n")).alias("before"))).alias("c")).select("source", "c.b", "c.before").collect()
            return {r["source"]: (r["b"], r["before"]) for r in found}

        outer = cut_of(self.texts, "bucket", rests)
        left = spark.createDataFrame([(s, outer[s][0], float(self.rests[s] - outer[s][1])) for s in outer] or [], "source string, cut int, rest double")
        inner = cut_of(self.texts.join(F.broadcast(left.select("source", "cut")), "source").where("bucket = cut"), "inner", left.select("source", "rest"))
        far = 1 << 30
        rows = [(s, outer.get(s, (far, 0))[0], inner.get(s, (far, 0))[0], outer.get(s, (0, 0))[1] + inner.get(s, (0, 0))[1]) for s in self.rests]
        cut = spark.createDataFrame(rows or [], "source string, cut int, cut_inner int, before bigint")
        steps = F.broadcast(self.plan.join(cut, "source").select("source", "passes", "rest", "cut", "cut_inner", "before"))  # one row per source
        placed = self.texts.join(steps, "source")
        inside = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        is_cut = (F.col("bucket") == F.col("cut")) & (F.col("inner") == F.col("cut_inner"))
        edge = placed.where(is_cut).withColumn("upto", F.col("before") + F.coalesce(inside, F.lit(0)) + F.col("n_tokens") / 2).withColumn("more", ((F.col("upto") <= F.col("rest")) & (F.col("n_tokens") > 0)).cast("int"))
        earlier = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("inner") < F.col("cut_inner")))
        plain = placed.where(~is_cut).withColumn("more", (earlier & (F.col("rest") > 0) & (F.col("n_tokens") > 0)).cast("int"))
        both = plain.unionByName(edge.drop("upto"))
        return both.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).cast("int").alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """Per target source: target and planned share, budget, texts and tokens used, share reached, most copies of a text."""
        used = self.chosen().groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        whole = self.plan.join(used, "source", "left").fillna(0, ["texts", "tokens", "most_copies"])
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
        return whole.select("source", "target_share", "max_repeats", "available", "weight", "budget", "texts", "tokens", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)).alias("share"), "most_copies")

    def blocks(self, seed: int = 42) -> DataFrame:
        """(doc_id, source, block, place): every copy with its block, and its place in the block's permutation.

        Block k holds the k-th copies; sorting a block by (place, doc_id) mixes its sources.
        """
        return self.chosen().select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("block")).withColumn("place", F.xxhash64("doc_id", "block", F.lit(seed)))
