"""Typed phrases mapped to a canonical list: token repair by edit distance, then soft TF-IDF."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import WHITESPACE, bounded, per_worker, salted_join, shuffle_partitions, written

UNMATCHED = "unmatched"
THRESHOLD = 0.55  # least score of an entry for a phrase to stand for it
TOKEN_SIM = 0.55  # least likeness of a repaired token
GLUED_SIM = 0.7  # least likeness of words run together
MAX_ENTRIES = 50_000  # entries of the reference list per block
MAX_WORDS = 1_000_000  # distinct words of the reference list: they are sent to every worker
STOP_SHARE, STOP_LEAST = 0.01, 10  # a word outside the list in so many of the phrases, and at least so many, may say nothing
SLOTS, STOP_SLOTS = 64, 8  # slots that words of the list are hashed into, and how many of them must be met beside a word that says nothing

# Closed-class English words and adverbs of doubt, which say nothing beside a name.
CLOSED = frozenset("a an the one some any this that or and so here there about like very my its maybe perhaps probably possibly".split())
# Characters taken for one another in typing and scanning.
LOOKALIKE = frozenset(p for a, b in ("1l", "1i", "0o", "3e", "5s", "6b", "4a", "7t", "8b", "9g", "2z", "li") for p in ((a, b), (b, a)))
AMBIGUOUS = frozenset(a for a, _ in LOOKALIKE)
VOWELS = frozenset("aeiou")
SPLIT = re.compile(r"[^0-9a-z]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def tokens_of(text: str) -> list[str]:
    return [t for t in SPLIT.split(fold(text)) if t]


def edit_cost(typed: str, meant: str, most: float) -> float:
    """Weighted edit distance with swapped neighbours; above ``most`` any larger value may come out.

    Doubled letters, dropped vowels, lookalikes and swaps cost less than other errors.
    """
    n, m = len(typed), len(meant)
    if abs(n - m) * 0.4 > most:
        return most + 1
    # Cost of leaving out each letter of the meant word: half for vowels and doubled letters.
    omit = [0.5 if d in VOWELS or (j and d == meant[j - 1]) else 1.0 for j, d in enumerate(meant)]
    before, row = [], [0.0]
    for d in meant:
        row.append(row[-1] + (0.5 if d in VOWELS else 1.0))
    previous, under = "", 0.0
    for i, c in enumerate(typed):
        last, extra = row, 0.5 if c == previous else 1.0
        left = last[0] + extra
        row, lowest = [left], left
        for j, d in enumerate(meant):
            if c == d:
                best = last[j]
            else:
                best = last[j] + (0.4 if (c, d) in LOOKALIKE else 1.0)
                if i and j and c == meant[j - 1] and previous == d:
                    swap = before[j - 1] + 0.7
                    if swap < best:
                        best = swap
            up = last[j + 1] + extra
            if up < best:
                best = up
            left += omit[j]
            if left < best:
                best = left
            row.append(best)
            left = best
            if best < lowest:
                lowest = best
        if lowest > most and under + 0.7 > most:  # a swap takes up from the row before
            return most + 1
        before, previous, under = last, c, lowest
    return row[m]


def bag(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in word:
        out[c] = out.get(c, 0) + 1
    return out


def least_cost(typed: dict[str, int], meant: dict[str, int]) -> float:
    """A bound no edit cost falls below, from the letters alone.

    A letter that only one side has costs half at least: a step costs half a letter or more,
    and one for both sides costs a whole, except 0.4 for lookalikes.
    """
    bound = 0.0
    for c, n in typed.items():
        extra = n - meant.get(c, 0)
        if extra > 0:
            bound += extra * (0.5 if c not in AMBIGUOUS else -0.1)
    for c, n in meant.items():
        extra = n - typed.get(c, 0)
        if extra > 0:
            bound += 0.5 * extra
    return bound


def likeness(typed: str, meant: str, least: float = TOKEN_SIM, bags: tuple | None = None) -> float:
    """1 less the edit cost per letter; 0 below ``least``. A plural s costs little."""
    if typed == meant:
        return 1.0
    size = max(len(typed), len(meant))
    most = (1 - least) * size + 1e-9
    if bags and least_cost(*bags) - 0.3 > most + 1e-9:
        return 0.0
    cost = edit_cost(typed, meant, most)
    if len(typed) > 3 and typed[-1] == "s" and meant[-1:] != "s":
        cost = min(cost, 0.2 + edit_cost(typed[:-1], meant, most))
    s = 1 - cost / size
    return s if s >= least - 1e-9 else 0.0


LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
PLACE = {c: i for i, c in enumerate(LETTERS)}
EXTRA = np.array([-0.1 if c in AMBIGUOUS else 0.5 for c in LETTERS], np.float32)


def counts_of(words: list[str]) -> np.ndarray:
    """Letters of each word: one row per word."""
    out = np.zeros((len(words), len(LETTERS)), np.int16)
    for k, w in enumerate(words):
        for c in w:
            out[k, PLACE[c]] += 1
    return out


VOWEL_CODES = np.array([c in VOWELS for c in LETTERS] + [False])
CHEAP = np.array([[(a, b) in LOOKALIKE for b in LETTERS] + [False] for a in LETTERS])
MANY = 48  # from so many words on they are compared side by side


def edit_costs(typed: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``edit_cost`` of one typed word to many, side by side. codes: the words' letters by row, padded; sizes: their lengths."""
    k, m = codes.shape
    doubled = np.zeros((k, m), bool)
    doubled[:, 1:] = codes[:, 1:] == codes[:, :-1]
    vowel = VOWEL_CODES[codes]
    omit = np.where(vowel | doubled, 0.5, 1.0)
    row = np.zeros((m + 1, k))
    row[1:] = np.cumsum(np.where(vowel, 0.5, 1.0), 1).T
    before, previous = row, -1
    for i, letter in enumerate(typed):
        c, last = PLACE[letter], row
        extra = 0.5 if c == previous else 1.0
        row = np.empty_like(last)
        row[0] = last[0] + extra
        hit, cheap = codes == c, CHEAP[c][codes]
        step = np.where(hit, 0.0, np.where(cheap, 0.4, 1.0)).T
        best = np.minimum(last[:-1] + step, last[1:] + extra)
        if i:
            swap = (codes[:, 1:] == previous) & (codes[:, :-1] == c) & ~hit[:, 1:]
            best[1:] = np.where(swap.T, np.minimum(best[1:], before[:-2] + 0.7), best[1:])
        for j in range(m):
            row[j + 1] = np.minimum(best[j], row[j] + omit[:, j])
        before, previous = last, c
    return row[sizes, np.arange(k)]


class Lexicon:
    """Words that a typed one may stand for, with a bound from their letters that spares most comparisons and loses none."""

    def __init__(self, words: list[str], least: float):
        self.words, self.least = words, least
        self.sizes = np.array([len(w) for w in words], np.int32)
        self.counts = counts_of(words)
        self.codes = np.full((len(words), int(self.sizes.max()) if words else 0), len(LETTERS), np.int8)
        for k, w in enumerate(words):
            self.codes[k, : len(w)] = [PLACE[c] for c in w]

    def _many(self, typed: str, near: np.ndarray) -> np.ndarray:
        """Likeness of words at these places, side by side."""
        sizes = self.sizes[near]
        codes = self.codes[near][:, : int(sizes.max())]
        costs = edit_costs(typed, codes, sizes)
        if len(typed) > 3 and typed[-1] == "s":
            single = (sizes == 0) | (codes[np.arange(len(near)), np.maximum(sizes - 1, 0)] != PLACE["s"])
            costs = np.where(single, np.minimum(costs, 0.2 + edit_costs(typed[:-1], codes, sizes)), costs)
        return 1 - costs / np.maximum(sizes, len(typed))

    def alike(self, typed: str, spread: int, better: float = 0.0) -> list[tuple[int, float]]:
        """(place, likeness) of words with a likeness of ``least`` or more, and over ``better``, whose length differs by at most 1 + length / spread."""
        if not self.words:
            return []
        n = len(typed)
        near = np.flatnonzero(np.abs(self.sizes - n) <= 1 + self.sizes // spread)
        if not len(near):
            return []
        extra = counts_of([typed])[0] - self.counts[near]
        bound = np.maximum(extra, 0) @ EXTRA + 0.5 * np.maximum(-extra, 0).sum(1)
        size = np.maximum(self.sizes[near], n)
        least = max(self.least, better)
        near = near[bound - 0.3 <= (1 - least) * size + 1e-6]
        if len(near) >= MANY:
            values = self._many(typed, near)
            keep = (values >= self.least - 1e-9) & (values > better - 1e-9)
            return list(zip(near[keep].tolist(), values[keep].tolist()))
        out = []
        for k in near.tolist():
            s = likeness(typed, self.words[k], self.least)
            if s >= self.least - 1e-9 and s > better - 1e-9:
                out.append((k, s))
        return out


class Entries:
    """A block of the reference list, ready to rank phrases against."""

    def __init__(self, items: list[tuple[list[str], str]], weight: dict[str, float], threshold: float = THRESHOLD):
        """items: (words, canonical) of each entry. weight: of every word, over the whole list."""
        self.items, self.weight, self.threshold = items, weight, threshold
        self.whole = [sum(weight[w] for w in t) for t, _ in items]
        holding: dict[str, list[tuple[float, int]]] = {}
        for k, (t, _) in enumerate(items):
            for w in set(t):
                holding.setdefault(w, []).append((self.whole[k], k))
        # Entries of a word by falling number of words around it: lighter entries first.
        self.holding = {w: tuple(zip(*sorted(p))) for w, p in holding.items()}
        self.joined = Lexicon(["".join(t) for t, _ in items], GLUED_SIM)

    def candidates(self, options: list[dict[str, float]], loose: list[float]) -> set[int]:
        """Entries that can score the threshold.

        Words are taken by what they can add at most, until those left could not reach it alone;
        of a word's entries only those light enough for all words together to reach it.
        """
        most = [max((s * self.weight[v] for v, s in o.items()), default=0.0) for o in options]
        limit = sum(most) / (self.threshold - 1e-9)
        order = sorted((i for i in range(len(options)) if most[i] > 0), key=lambda i: -most[i])
        left, spent, found = sum(most), 0.0, set()
        for i in order:
            if left < (self.threshold - 1e-9) * (left + spent):
                break
            for v in options[i]:
                if v in self.holding:
                    whole, places = self.holding[v]
                    found.update(places[: bisect_right(whole, limit + 1e-9)])
            left -= most[i]
            spent += loose[i]
        return found

    def rank(self, words: list[str], kept: list[str], options: list[dict[str, float]], usual: float) -> tuple[float, str]:
        """Best score and its canonical value; ties go to the alphabetically first value.

        words: of the phrase; kept: those that say something, with the words of the list that each
        may mean. A score is soft TF-IDF: likeness times weight of the words matched, over the
        weight of the entry and of the words left over. Words run together or broken apart are
        compared with whole entries as well.
        """
        loose = [usual if not o else max(self.weight[v] for v in o) for o in options]
        best = (0.0, UNMATCHED)
        for k in sorted(self.candidates(options, loose)):
            entry, canonical = self.items[k]
            pairs = sorted(((o[v], i, j) for j, v in enumerate(entry) for i, o in enumerate(options) if v in o), reverse=True)
            used_i, used_j, got = set(), set(), 0.0
            for s, i, j in pairs:
                if i not in used_i and j not in used_j:
                    used_i.add(i)
                    used_j.add(j)
                    got += s * self.weight[entry[j]]
            rest = sum(x for i, x in enumerate(loose) if i not in used_i)
            score = got / (self.whole[k] + rest)
            if score > best[0] + 1e-9 or (abs(score - best[0]) <= 1e-9 and canonical < best[1]):
                best = (score, canonical)
        for glued in sorted({"".join(kept), "".join(words)}):
            if len(glued) > 3:
                for k, s in self.joined.alike(glued, 3, best[0] / 0.97):
                    s, canonical = s * 0.97, self.items[k][1]
                    if s > best[0] + 1e-9 or (abs(s - best[0]) <= 1e-9 and canonical < best[1]):
                        best = (s, canonical)
        return best


def _entry_words(entries: DataFrame) -> DataFrame:
    """(words, canonical) of each entry; the canonical value's own words are one too. Equal words belong to the alphabetically first value."""

    def split(batches):
        for b in batches:
            rows = [(tokens_of(t), c) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            rows = [r for r in rows if r[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string())], names=["words", "canonical"])

    known = entries.where("canonical is not null").select("canonical", "text")
    own = known.select("canonical", F.translate("canonical", "_", " ").alias("text"))
    return known.where("text is not null").unionByName(own).distinct().mapInArrow(split, "words array<string>, canonical string").groupBy("words").agg(F.min("canonical").alias("canonical"))


def _phrase_words(phrases: DataFrame) -> DataFrame:
    """(phrase, words) of each distinct phrase."""

    def split(batches):
        for b in batches:
            typed = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(typed, pa.string()), pa.array([tokens_of(t) for t in typed], pa.list_(pa.string()))], names=["phrase", "words"])

    return phrases.where("phrase is not null").distinct().mapInArrow(split, "phrase string, words array<string>")


OPTION = "array<struct<word:string,s:double>>"


def _repairs(tokens: DataFrame, words: list[str]) -> DataFrame:
    """(token, n, exact, options): each distinct token with the words of the list it may mean, by edit distance."""
    spark = tokens.sparkSession
    sent, key = spark.sparkContext.broadcast(sorted(words)), uuid.uuid4().hex  # at most MAX_WORDS words
    option = pa.list_(pa.struct([("word", pa.string()), ("s", pa.float64())]))

    def repair(batches):
        lexicon = per_worker(("lexicon", key), lambda: Lexicon(sent.value, TOKEN_SIM))
        known = per_worker(("words", key), lambda: set(sent.value))
        for b in batches:
            typed = b.column(0).to_pylist()
            found = [[{"word": lexicon.words[k], "s": s} for k, s in lexicon.alike(t, 2)] for t in typed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t in known for t in typed], pa.bool_()), pa.array(found, option)], names=["token", "n", "exact", "options"])

    # Comparing costs far more than moving the distinct tokens: small partitions are not coalesced.
    return tokens.repartition(shuffle_partitions(spark), F.xxhash64("token")).mapInArrow(repair, f"token string, n bigint, exact boolean, options {OPTION}")


def map_phrases(phrases: DataFrame, entries: DataFrame, max_entries: int = MAX_ENTRIES, threshold: float = THRESHOLD) -> DataFrame:
    """(phrase, canonical, score) of each distinct phrase; canonical is ``unmatched`` under the threshold.

    phrases: one column ``phrase``; it is made distinct first, combined map-side, so that a
    phrase in a third of all rows costs one row per task. Each distinct token of the phrases is
    joined once to the words of the list by edit distance; tokens in a great many phrases are
    salted when that comes back. Tokens outside the list that are numbers or closed-class words,
    or stand in many phrases beside many different words of the list, say nothing. entries: (canonical, text), the reference list. Its
    weights are those of the whole list; it goes to the workers in blocks of at most
    max_entries entries, and the best score over the blocks wins. A list of more than
    ``MAX_WORDS`` distinct words is an error.
    """
    spark = phrases.sparkSession
    listed = written(_entry_words(entries))
    n_entries = listed.count()
    counts = bounded(listed.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), MAX_WORDS)
    weight = {r["w"]: math.log(1 + n_entries / r["n"]) for r in counts}
    usual = math.log(1 + n_entries)

    split = written(_phrase_words(phrases))
    tokens = split.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    repaired = written(_repairs(tokens, list(weight)))
    placed = split.select("phrase", F.posexplode("words").alias("place", "token"))
    joined = salted_join(placed, repaired, "token", ["phrase", "place"])
    rows = joined.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "token", "exact", "options"))).alias("words"))
    rows = written(rows.repartition(shuffle_partitions(spark), F.xxhash64("phrase")))  # as above
    idle = _idle_words(rows, repaired, split.count())

    blocks = max(1, -(-n_entries // max_entries))
    place = F.pmod(F.xxhash64("words"), F.lit(blocks))
    ranked = None
    for k in range(blocks):
        items = sorted((list(r["words"]), r["canonical"]) for r in (listed if blocks == 1 else listed.where(place == k)).collect())  # about max_entries
        block = spark.sparkContext.broadcast((items, {w: weight[w] for t, _ in items for w in t}))
        part = rows.mapInArrow(_ranker(block, uuid.uuid4().hex, weight if blocks > 1 else None, usual, threshold, idle), "phrase string, score double, canonical string")
        ranked = part if ranked is None else ranked.unionByName(part)
    if blocks > 1:
        # The greatest score wins; of equal ones the alphabetically first value, ``unmatched`` last.
        order = F.struct(-F.col("score"), (F.col("canonical") == UNMATCHED).cast("int"), F.col("canonical"))
        ranked = ranked.groupBy("phrase").agg(F.max("score").alias("score"), F.min_by("canonical", order).alias("canonical"))
    return ranked


def _idle_words(rows: DataFrame, repaired: DataFrame, n_phrases: int) -> frozenset[str]:
    """Words outside the list that say nothing about what they stand beside: in many phrases, and there beside many different words of the list.

    Words in one phrase of a hundred are at most a hundred times as many as a phrase has words.
    The words of the list beside them are hashed into ``SLOTS`` slots; a slot counts if a
    hundredth of the word's phrases meet it, so that chance does not.
    """
    least = max(STOP_LEAST, STOP_SHARE * n_phrases)
    often = {r["token"]: r["n"] for r in bounded(repaired.where(~F.col("exact") & (F.col("n") >= least)).select("token", "n"), 1_000_000)}
    if not often:
        return frozenset()
    beside = F.array_distinct(F.transform(F.filter("words", lambda w: w["exact"]), lambda w: F.pmod(F.xxhash64(w["token"]), F.lit(SLOTS))))
    met = rows.select(F.explode(F.array_distinct(F.transform(F.filter("words", lambda w: w["token"].isin(*often)), lambda w: w["token"]))).alias("token"), beside.alias("slots"))
    counts = met.select("token", F.explode("slots").alias("slot")).groupBy("token", "slot").count().join(repaired.select("token", "n"), "token")
    wide = counts.where(F.col("count") * 100 >= F.col("n")).groupBy("token").agg(F.count(F.lit(1)).alias("slots")).where(F.col("slots") >= STOP_SLOTS)
    return frozenset(r["token"] for r in wide.select("token").collect())  # a part of often


def says_nothing(token: str, idle: frozenset[str] = frozenset()) -> bool:
    return token in CLOSED or token in idle or re.fullmatch(r"\d+x?", token) is not None


def _ranker(block, key: str, weight: dict | None, usual: float, threshold: float, idle: frozenset[str]):
    """Ranks phrases against a block. weight: of all words of the list, where a block does not hold all. idle: words that say nothing."""

    def rank(batches):
        reference = per_worker(("entries", key), lambda: Entries(block.value[0], weight or block.value[1], threshold))
        for b in batches:
            typed, best = b.column(0).to_pylist(), []
            for words in b.column(1).to_pylist():
                kept = [w for w in words if w["exact"] or not says_nothing(w["token"], idle)] or words
                options = [{o["word"]: o["s"] for o in w["options"]} for w in kept]
                best.append(reference.rank([w["token"] for w in words], [w["token"] for w in kept], options, usual))
            names = [c if s >= threshold else UNMATCHED for s, c in best]
            yield pa.RecordBatch.from_arrays([pa.array(typed, pa.string()), pa.array([s for s, _ in best], pa.float64()), pa.array(names, pa.string())], names=["phrase", "score", "canonical"])

    return rank


def canonical_labels(outputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(output_id, token_no, canonical) of every entry of unresolved_tokens.

    token_no is the 0-based place; canonical is the value the typed phrase stands for, or
    ``unmatched``. Case, accents, white space and surrounding filler words do not matter.
    A null or blank entry stands for nothing and is unmatched; a null or empty array gives no
    row. Repeated outputs count each. With an empty reference list all is unmatched. Phrases
    of any length are read whole. Further columns are ignored.
    """
    entries = aliases.select("canonical", F.col("normalized_alias").alias("text"))
    typed = outputs.select("output_id", F.posexplode("unresolved_tokens").alias("token_no", "typed")).select(
        "output_id", F.col("token_no").cast("int"), F.lower(F.btrim(F.col("typed"), F.lit(WHITESPACE))).alias("phrase")
    )
    known = map_phrases(typed.select("phrase"), entries).select("phrase", "canonical")
    joined = salted_join(typed.withColumn("phrase", F.coalesce("phrase", F.lit(""))), known, "phrase", ["output_id", "token_no"], "left")
    return joined.select("output_id", "token_no", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))


def unmatched_report(outputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, n_phrases, n_outputs) over all entries, with a row for the unmatched ones."""
    return canonical_labels(outputs, aliases).groupBy("canonical").agg(F.count(F.lit(1)).alias("n_phrases"), F.count_distinct("output_id").alias("n_outputs"))
