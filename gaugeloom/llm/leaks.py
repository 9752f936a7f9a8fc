"""Held-out passages inside a corpus: BM25 with block-max WAND, then an exact check of word runs."""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import heavy_keys, per_worker, shuffle_partitions, spread, written

RUN = 12  # consecutive words that make a leak
WINDOW = 24  # words of a document asked at once; windows overlap by RUN - 1 words
BLOCK = 16  # postings per block of a list
RANGES = 64  # ranges of passages, at most, whose greatest weights are kept per term
K1, B = 1.2, 0.75
MAX_PASSAGES = 2000  # passages in one index

WORD = re.compile(r"[^\W_]+")
END = 1 << 60


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters or digits, without case."""
    return WORD.findall(text.casefold())


class PassageIndex:
    """Inverted index of passages with BM25 weights and block maxima.

    Weights are divided by the least score that any RUN consecutive words of the passage
    reach, so a text that holds such a run scores at least 1 with that passage: the threshold
    1 loses no leak.
    """

    def __init__(self, passages: list[tuple[int, str]]):
        docs = [(i, words_of(t)) for i, t in sorted(passages)]
        docs = [(i, w) for i, w in docs if len(w) >= RUN]
        self.ids = [i for i, _ in docs]
        n = len(docs)
        mean = sum(len(w) for _, w in docs) / n if n else 1.0
        holders: dict[str, int] = {}
        for _, w in docs:
            for t in set(w):
                holders[t] = holders.get(t, 0) + 1
        idf = {t: math.log(1 + (n - h + 0.5) / (h + 0.5)) for t, h in holders.items()}
        self.runs: list[set[tuple[str, ...]]] = []
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, (_, w) in enumerate(docs):
            count: dict[str, int] = {}
            for t in w:
                count[t] = count.get(t, 0) + 1
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in count.items()}
            runs = {tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)}
            least = min(sum(weight[t] for t in set(r)) for r in runs) * (1 - 1e-9)
            self.runs.append(runs)
            for t, x in weight.items():
                lists.setdefault(t, []).append((k, x / least))
        # Per term: passages, weights, greatest weight, and per block its last passage and greatest weight.
        self.postings = {}
        for t, p in lists.items():
            at, weights = [k for k, _ in p], [x for _, x in p]
            cuts = range(0, len(p), BLOCK)
            self.postings[t] = at, weights, max(weights), [at[min(i + BLOCK, len(p)) - 1] for i in cuts], [max(weights[i : i + BLOCK]) for i in cuts]

        # Greatest weight of each term in each range of passages, a little raised against rounding.
        self.size = max(BLOCK, -(-n // RANGES))
        self.terms = {t: i for i, t in enumerate(lists)}
        self.ranges = np.zeros((len(lists), -(-n // self.size) if n else 1), np.float32)
        for t, p in lists.items():
            for k, x in p:
                at = self.terms[t], k // self.size
                self.ranges[at] = max(self.ranges[at], x * (1 + 1e-6))

    def search(self, words: list[str]) -> list[int]:
        """Positions of all passages that score at least 1 with the words (block-max WAND).

        Ranges of passages whose greatest weights together stay under 1 are skipped whole.
        """
        known = [t for t in set(words) if t in self.terms]
        live = np.flatnonzero(self.ranges[[self.terms[t] for t in known]].sum(0) >= 1 - 1e-5) if known else ()
        if not len(live):
            return []
        lists = [self.postings[t] for t in known]
        starts = (live * self.size).tolist()
        alive = set(live.tolist())
        cursors = [[p[0][0], 0, p] for p in lists]  # passage, place, posting list
        for c in cursors:
            self._seek(c, starts[0])
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] == END:
                    break
                bound += c[2][2]
                if bound >= 1:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            if doc // self.size not in alive:
                j = bisect_left(starts, doc)
                if j == len(starts):
                    return found
                for c in cursors[: pivot + 1]:
                    self._seek(c, starts[j])
                continue
            # Block maxima at the pivot passage, and where the first of these blocks ends.
            block_bound, block_end = 0.0, END
            for c in cursors[: pivot + 1]:
                last = c[2][3]
                j = bisect_left(last, doc)
                if j < len(last):
                    block_bound += c[2][4][j]
                    block_end = min(block_end, last[j])
            if block_bound < 1:  # no passage up to the end of these blocks can reach 1
                to = block_end + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, doc + 1)
                for c in cursors[: pivot + 1]:
                    self._seek(c, to)
            elif cursors[0][0] == doc:
                if sum(c[2][1][c[1]] for c in cursors[: pivot + 1]) >= 1:
                    found.append(doc)
                for c in cursors[: pivot + 1]:
                    self._seek(c, doc + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < doc:
                        self._seek(c, doc)

    @staticmethod
    def _seek(cursor: list, to: int) -> None:
        at = cursor[2][0]
        cursor[1] = bisect_left(at, to, cursor[1])
        cursor[0] = at[cursor[1]] if cursor[1] < len(at) else END

    def leaks(self, text: str) -> dict[int, int]:
        """Passage id -> number of the text's word runs that stand in the passage."""
        return self.leaks_of(words_of(text))

    def leaks_of(self, words: list[str]) -> dict[int, int]:
        """As ``leaks``, of words. Only stretches of RUN or more words that passages have can hold a run; each is asked window by window."""
        out: dict[int, int] = {}
        start, n = 0, len(words)
        while start < n:
            if words[start] not in self.terms:
                start += 1
                continue
            end = start + 1
            while end < n and words[end] in self.terms:
                end += 1
            for at in range(start, end - RUN + 1, WINDOW - RUN + 1):
                part = words[at : min(at + WINDOW, end)]
                if len(part) < RUN:
                    break
                hits = self.search(part)
                if hits:
                    grams = [tuple(part[i : i + RUN]) for i in range(len(part) - RUN + 1)]
                    for k in hits:
                        found = sum(g in self.runs[k] for g in grams)
                        if found:
                            out[self.ids[k]] = out.get(self.ids[k], 0) + found
            start = end + 1
        return out


def leaked_passages(documents: DataFrame, passages: DataFrame, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """(doc_id, eval_id, n_runs): documents that hold at least 12 consecutive words of a passage.

    n_runs counts the document's runs of 12 words that stand in the passage. The index is asked
    with every window of 24 words of a document; the threshold of the search is the least score
    a leak can have, so none is lost. Up to max_passages passages make one index, which goes to
    the tasks, and nothing is shuffled (a corpus in fewer splits than cores is spread first).
    More make as many indexes as they need, and the documents' windows are routed to those that
    can hold their runs (``_routed``): still one pass over the corpus. Null texts and passages,
    and passages under 12 words, leak nowhere. Very long texts are read whole, window by window.
    Texts repeated under other doc_ids count each; rows of one doc_id are one document, and
    passages of one eval_id one passage: their runs are added. Empty tables give an empty result.
    """
    listed = passages.select(F.col("eval_id").cast("bigint"), "passage").where("eval_id is not null and passage is not null").distinct()
    texts = spread(documents.select(F.col("doc_id").cast("bigint"), "text").where("text is not null"), "doc_id")
    rows = listed.limit(max_passages + 1).collect()
    if len(rows) > max_passages:
        return _routed(texts, listed, max_passages)
    sent, key = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

    def ask(batches):
        index = per_worker(("passages", key), lambda: PassageIndex(sent.value))
        for b in batches:
            yield _leak_batch([(d, e, n) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e, n in index.leaks(t).items()])

    return texts.mapInArrow(ask, LEAKS).groupBy("doc_id", "eval_id").agg(F.sum("n_runs").alias("n_runs"))


LEAKS = "doc_id bigint, eval_id bigint, n_runs bigint"
SLOTS = 1 << 20  # counters of how many passages have a word; words in one slot count together


def _leak_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "eval_id", "n_runs"])


def slots_of(words: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % SLOTS for w in words]


def segments(words: list[str], held: np.ndarray) -> list[tuple[int, int, int]]:
    """(route, start, end): stretches of words whose runs of RUN words all have the same route.

    The route of a run is the slot of its rarest word, by the passages' counts ``held``: the same
    for equal runs, wherever they stand. Runs with a word that no passage has are left out.
    """
    slots = slots_of(words)
    counts = held[slots].tolist() if slots else []
    out: list[tuple[int, int, int]] = []
    window: deque[int] = deque()
    known = 0
    for i, (slot, count) in enumerate(zip(slots, counts)):
        if not count:
            known = 0
            window.clear()
            continue
        known += 1
        while window and (counts[window[-1]], slots[window[-1]]) >= (count, slot):
            window.pop()
        window.append(i)
        if window[0] <= i - RUN:
            window.popleft()
        if known >= RUN:
            route, start = slots[window[0]], i - RUN + 1
            if out and out[-1][0] == route and out[-1][2] == i:
                out[-1] = route, out[-1][1], i + 1
            else:
                out.append((route, start, i + 1))
    return out


def _routed(texts: DataFrame, listed: DataFrame, max_passages: int) -> DataFrame:
    """``leaked_passages`` with more passages than one index takes: one pass over the corpus and one shuffle of what can leak.

    Every run of a document is sent to the one index that has all passages with a run of its
    route, so each run is asked and counted once. Routes need one table of a fixed size. Routes
    are hashed to shards of about max_passages passages; a shard that gets more than its part
    of the corpus is repeated and its documents salted.
    """
    spark = texts.sparkSession
    parts = max(8, shuffle_partitions(spark))

    def count(batches):
        for b in batches:
            total: dict[int, int] = {}
            for t in b.column(1).to_pylist():
                for s in set(slots_of(words_of(t))):
                    total[s] = total.get(s, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["slot", "n"])

    held = np.zeros(SLOTS, np.int64)
    for r in listed.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        held[r["slot"]] = r["n"]
    sent = spark.sparkContext.broadcast(held)

    def cut(batches, whole):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                found = segments(words, sent.value)
                rows += [(r, i, t) for r in sorted({r for r, _, _ in found})] if whole else [(r, i, " ".join(words[s:e])) for r, s, e in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["route", "id", "text"])

    schema = "route int, id bigint, text string"
    held_by = written(listed.mapInArrow(lambda batches: cut(batches, True), schema))
    asked = written(texts.mapInArrow(lambda batches: cut(batches, False), schema))
    shards = max(1, -(-held_by.count() // max_passages))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int").alias("shard")
    asked = asked.select(shard, "id", "text")
    heavy = heavy_keys(asked.select("shard"), "shard", parts)
    salts = min(64, parts)
    hot = F.col("shard").isin(heavy) if heavy else F.lit(False)
    right = held_by.select(shard, "id", "text").distinct().select("shard", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.lit(0).alias("kind"), "id", "text")
    left = asked.select("shard", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0).alias("salt"), F.lit(1).alias("kind"), "id", "text")
    both = left.unionByName(right).repartition(max(parts, min(shards, 8 * parts)), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def ask(batches):
        at, passages, index = None, [], None
        for b in batches:
            out = []
            for key, salt, kind, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if (key, salt) != at:
                    at, passages, index = (key, salt), [], None
                if kind == 0:
                    passages.append((i, t))
                else:
                    if index is None:
                        index = PassageIndex(passages)
                    out += [(i, e, n) for e, n in index.leaks_of(t.split(" ")).items()]
            yield _leak_batch(out)

    return both.mapInArrow(ask, LEAKS).groupBy("doc_id", "eval_id").agg(F.sum("n_runs").alias("n_runs"))


def leak_report(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(eval_id, n_documents, n_runs) per leaked passage."""
    return leaked_passages(documents, passages).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_runs").alias("n_runs"))
