"""Frequency of every distinct value: burst-trie counting with marks for rare and common terms."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import shuffle_partitions, written

BURST = 256  # suffixes a container holds before it becomes a node
MAX_ROUTES = 4096  # prefixes the driver hands out for routing; terms beyond are routed by hash
HELD = 1_000_000  # rows a task counts before its subtrees are passed on
RARE_BELOW = 3
COMMON_ABOVE = 0.3


class Container(dict):
    """Suffix -> [occurrences, records] below one prefix."""


class BurstTrie:
    """Counting trie: containers of suffixes burst into nodes of one character each as they grow.

    A node is a dict from the next character to its child; under the empty key it has the
    counters of the term that ends there. A prefix is stored once, and only as deep as the
    number of terms below it asks for.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.root = burst, {}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, i = self.root, None, 0
        while type(node) is dict and i < len(term):
            parent = node
            node = parent.setdefault(term[i], Container()) if term[i] not in parent else parent[term[i]]
            i += 1
        if type(node) is dict:
            counter = node.setdefault("", [0, 0])
        else:
            counter = node.setdefault(term[i:], [0, 0])
            if len(node) > self.burst:
                inner: dict = {}
                for s, c in node.items():
                    if s:
                        inner.setdefault(s[0], Container())[s[1:]] = c
                    else:
                        inner[""] = c
                parent[term[i - 1]] = inner
        counter[0] += occurrences
        counter[1] += records

    def subtrees(self):
        """(prefix, {suffix: [occurrences, records]}) of every container, and of terms that end in a node."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if type(node) is dict:
                if "" in node:
                    yield prefix, {"": node[""]}
                todo += [(prefix + c, child) for c, child in node.items() if c]
            else:
                yield prefix, node


def long_terms(df: DataFrame, field: str, term: Column, record: Column) -> DataFrame:
    """(field_name, term, record) with null terms left out."""
    return df.select(F.lit(field).alias("field_name"), term.alias("term"), record.cast("string").alias("record")).where("term is not null")


def _trie_counts(terms: DataFrame, burst: int, max_routes: int) -> DataFrame:
    """(field_name, term, occurrences, records) from rows of the same columns, each (term, record) in one row."""
    spark = terms.sparkSession
    parts = shuffle_partitions(spark)

    def build(batches):
        tries: dict[str, BurstTrie] = {}
        held = 0
        for b in batches:
            for f, t, o, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                tries.setdefault(f, BurstTrie(burst)).add(t, o, r)
            held += b.num_rows
            if held > HELD:  # what was counted so far is passed on; the counters of equal terms meet in the merge
                yield from pass_on(tries)
                tries, held = {}, 0
        yield from pass_on(tries)

    def pass_on(tries):
        for f, trie in tries.items():
            rows = []
            for prefix, suffixes in trie.subtrees():
                rows.append((f, prefix, list(suffixes), [c[0] for c in suffixes.values()], [c[1] for c in suffixes.values()]))
                if len(rows) == 512:
                    yield _subtree_batch(rows)
                    rows = []
            if rows:
                yield _subtree_batch(rows)

    def _subtree_batch(rows):
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["field_name", "prefix", "suffixes", "occurrences", "records"])

    local = written(terms.mapInArrow(build, "field_name string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"))

    # Adaptive prefixes: those under which most terms lie, with as many cells each as their size asks for.
    sizes = local.groupBy("field_name", "prefix").agg(F.sum(F.size("suffixes")).alias("n")).orderBy(F.desc("n"), "field_name", "prefix").limit(max_routes).collect()
    total = local.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0)).alias("n")).first()["n"]
    cell = max(1, total // (4 * parts))
    routes = {(r["field_name"], r["prefix"]): 1 + r["n"] // cell for r in sizes}

    def route(batches):
        for b in batches:
            rows = []
            for f, prefix, suffixes, occ, rec in zip(*(b.column(i).to_pylist() for i in range(5))):
                for s, o, r in zip(suffixes, occ, rec):
                    term, place = prefix + s, ""
                    for k in range(min(len(term), 64), -1, -1):
                        if (f, term[:k]) in routes:
                            place = term[:k]
                            break
                    cells = routes.get((f, place), parts)
                    rows.append((f, place, zlib.crc32(term.encode("utf-8", "surrogatepass")) % cells if cells > 1 else 0, term, o, r))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["field_name", "route", "cell", "term", "occurrences", "records"])

    def merge(batches):
        tries: dict[str, BurstTrie] = {}
        for b in batches:
            for f, t, o, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                tries.setdefault(f, BurstTrie(burst)).add(t, o, r)
        for f, trie in tries.items():
            for prefix, suffixes in trie.subtrees():
                n = len(suffixes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * n, pa.string()), pa.array([prefix + s for s in suffixes], pa.string()), pa.array([c[0] for c in suffixes.values()], pa.int64()), pa.array([c[1] for c in suffixes.values()], pa.int64())],
                    names=["field_name", "term", "occurrences", "records"],
                )

    routed = local.mapInArrow(route, "field_name string, route string, cell int, term string, occurrences bigint, records bigint")
    placed = routed.repartition(parts, "field_name", "route", "cell").select("field_name", "term", "occurrences", "records")
    return placed.mapInArrow(merge, "field_name string, term string, occurrences bigint, records bigint")


def count_terms(terms: DataFrame, burst: int = BURST, max_routes: int = MAX_ROUTES) -> DataFrame:
    """(field_name, term, occurrences, records, of_records, mark) of every distinct term.

    terms: (field_name, term, record), see ``long_terms``. Rows are first combined to one per
    (field, term, record), map-side, so neither a hot term nor a hot record meets in one task,
    and record counts add up wherever the pairs lie. Each task then counts its pairs in a
    burst trie; the subtrees are written to the shared folder, routed by adaptive prefixes and
    merged per route. of_records: distinct records with a non-null value.
    mark: ``rare`` under 3 records, else ``common`` over 30 percent of the records, else null.

    A null record counts as an occurrence, not as a record. The empty text is a term. Terms of
    any length are kept whole. An empty table gives an empty result.
    """
    pairs = terms.groupBy("field_name", "term", "record").agg(F.count(F.lit(1)).alias("n"))
    counted = _trie_counts(
        pairs.select("field_name", "term", F.col("n").alias("occurrences"), F.when(F.col("record").isNotNull(), 1).otherwise(0).cast("bigint").alias("records")), burst, max_routes
    )
    totals = terms.groupBy("field_name").agg(F.count_distinct("record").alias("of_records"))
    joined = counted.join(F.broadcast(totals), "field_name")  # one row per field
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > COMMON_ABOVE * F.col("of_records"), "common")
    return joined.withColumn("mark", mark).select("field_name", "term", "occurrences", "records", "of_records", "mark")


def label_terms(annotations: DataFrame, prostheses: DataFrame, targets: DataFrame) -> DataFrame:
    """The three label fields in long form: trimmed of spaces, in lower case."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    return (
        long_terms(annotations, "category_name", plain("category_name"), F.col("image_id"))
        .unionByName(long_terms(prostheses, "part8", plain("part8"), F.col("image_id")))
        .unionByName(long_terms(targets, "coarse_part", plain("coarse_part"), F.col("item_id")))
    )


def marked_terms(counts: DataFrame) -> DataFrame:
    """(field_name, term, mark) of the terms with a mark."""
    return counts.where("mark is not null").select("field_name", "term", "mark")
