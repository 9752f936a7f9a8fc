import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gaugeloom.llm import phrases, terms


def brute(rows):
    occ, recs, of = Counter(), defaultdict(set), defaultdict(set)
    for f, t, r in rows:
        if t is None:
            continue
        occ[f, t] += 1
        recs[f, t]
        if r is not None:
            recs[f, t].add(r)
            of[f].add(r)
    out = {}
    for (f, t), n in occ.items():
        k, total = len(recs[f, t]), len(of[f])
        out[f, t] = (n, k, total, "rare" if k < 3 else "common" if k > 0.3 * total else None)
    return out


def counted(df, **kw):
    return {(r.field_name, r.term): (r.occurrences, r.records, r.of_records, r.mark) for r in terms.count_terms(df, **kw).collect()}


def test_counts_agree_with_brute_force(spark):
    rng = random.Random(4)
    words = ["", "a", "ab", "abc", "abcd", "é", "x" * 5000, "ab ", "日本"] + [f"t{i}" for i in range(300)]
    rows = [(rng.choice("fg"), "a" if rng.random() < 0.3 else rng.choice(words), "hot" if rng.random() < 0.3 else str(rng.randrange(60))) for _ in range(4000)]
    rows += [("f", None, "1"), ("f", "nul", None), ("f", "nul", None), ("h", "only", None)] + [("f", "abc", "7")] * 50
    df = spark.createDataFrame(rows, "field_name string, term string, record string").where("term is not null").repartition(5)
    want = brute(rows)
    assert counted(df) == want
    for burst, routes in ((1, 3), (4, 1), (16, 4096)):  # tries burst early, few prefixes are routed
        assert counted(df, burst=burst, max_routes=routes) == want
    assert terms.count_terms(df.limit(0)).count() == 0


def test_trie_keeps_every_term():
    rng = random.Random(1)
    trie, want = terms.BurstTrie(3), Counter()
    for _ in range(3000):
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        trie.add(t, 2, 1)
        want[t] += 1
    got = {p + s: c for p, sub in trie.subtrees() for s, c in sub.items()}
    assert got == {t: [2 * n, n] for t, n in want.items()}


def test_label_fields(spark):
    a = spark.createDataFrame([(1, " Person "), (2, "person"), (3, None), (None, "x"), (4, "PERSON"), (5, "x")], "image_id bigint, category_name string").withColumn("term", F.lit("clash"))
    p = spark.createDataFrame([(1, "L")], "image_id bigint, part8 string")
    t = spark.createDataFrame([("i", "c"), ("i", "c")], "item_id string, coarse_part string")
    got = counted(terms.label_terms(a, p, t))
    assert got == {("category_name", "person"): (3, 3, 4, "common"), ("category_name", "x"): (2, 1, 4, "rare"), ("part8", "l"): (1, 1, 1, "rare"), ("coarse_part", "c"): (2, 1, 1, "rare")}


ENTRIES = [("left", "left hand side"), ("upper_arm", "upper arm"), ("upper_arm", "arm over elbow"), ("pylon_tube", "metal pylon"), ("calf", "leg under knee"), ("thigh", "leg over knee"), ("compression_sock", "tight stocking"), ("crutch", "walking crutch")]


def ranker(entries):
    """Ranks one phrase against a list, as the table form does."""
    import math
    from collections import Counter

    items = {}
    for c, text in sorted([*entries, *((c, c.replace("_", " ")) for c, _ in entries)]):
        items.setdefault(tuple(phrases.tokens_of(text)), c)
    items = sorted((list(k), c) for k, c in items.items() if k)
    n = Counter(w for k, _ in items for w in set(k))
    weight = {w: math.log(1 + len(items) / m) for w, m in n.items()}
    lexicon, block = phrases.Lexicon(sorted(weight), phrases.TOKEN_SIM), phrases.Entries(items, weight)

    def rank(phrase):
        words = phrases.tokens_of(phrase)
        kept = [w for w in words if w in weight or not phrases.says_nothing(w)] or words
        return block.rank(words, kept, [{lexicon.words[k]: s for k, s in lexicon.alike(w, 2)} for w in kept], math.log(1 + len(items))) if kept else (0.0, phrases.UNMATCHED)

    return rank, items, weight


def test_ranking():
    rank = ranker(ENTRIES)[0]
    for typed, want in {
        "uper arm": "upper_arm", "UPPER ÁRM": "upper_arm", "upperarm": "upper_arm", "arm-upper": "upper_arm", "elbow over arm": "upper_arm", "so a upper arm 2x": "upper_arm", "leg undre knee": "calf", "leg ovr knee": "thigh",
        "pylontube": "pylon_tube", "mtal pyln": "pylon_tube", "tihgt stöcking": "compression_sock", "wa1king crutches": "crutch", "left": "left", "lfet": "left", "cr-utch": "crutch",
    }.items():
        score, got = rank(typed)
        assert got == want and score >= phrases.THRESHOLD, (typed, score, got)
    for typed in ("violin bow", "garden fence", "ticket booth", "the old", "12", "", "?!", "日本"):
        assert rank(typed)[0] < phrases.THRESHOLD, typed


def test_words_side_by_side_cost_what_each_costs():
    rng = random.Random(8)
    words = ["".join(rng.choice("abels1i3") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    for least in (0.55, 0.7):
        lexicon = phrases.Lexicon(words, least)
        for _ in range(60):
            typed = "".join(rng.choice("abels1i3") for _ in range(rng.randrange(1, 9)))
            want = {k: s for k, w in enumerate(words) if abs(len(w) - len(typed)) <= 1 + len(w) // 2 and (s := phrases.likeness(typed, w, least))}
            got = dict(lexicon.alike(typed, 2))
            assert got.keys() == want.keys() and all(abs(got[k] - s) < 1e-9 for k, s in want.items())


def test_pruning_loses_no_entry_over_the_threshold():
    """Every entry that scores the threshold by its words is a candidate, and the lexicon's bound loses no likeness."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    entries = [(f"c{k}", " ".join(rng.choice(vocabulary[: rng.choice([10, 150])]) for _ in range(rng.randrange(1, 4)))) for k in range(400)]
    rank, items, weight = ranker(entries)
    lexicon, block = phrases.Lexicon(sorted(weight), phrases.TOKEN_SIM), phrases.Entries(items, weight)
    for _ in range(150):
        typed = " ".join("".join(c for c in w if rng.random() > 0.1) or "x" for w in rng.choice(items)[0] + rng.sample(vocabulary, rng.randrange(2)))
        kept = phrases.tokens_of(typed)
        options = []
        for w in kept:
            near = {v for v in weight if abs(len(v) - len(w)) <= 1 + len(v) // 2}
            slow = {v: s for v in near if (s := phrases.likeness(w, v))}
            assert slow == {lexicon.words[k]: s for k, s in lexicon.alike(w, 2)}
            options.append(slow)
        usual = 5.0
        loose = [usual if not o else max(weight[v] for v in o) for o in options]
        found = block.candidates(options, loose)
        for k, (entry, _) in enumerate(items):
            got = sum(max((o[v] * weight[v] for v in entry if v in o), default=0.0) for o in options)  # no less than the score's
            used = [any(v in o for v in entry) for o in options]
            if got and got / (block.whole[k] + sum(x for x, u in zip(loose, used) if not u)) >= phrases.THRESHOLD:
                assert k in found or got > block.whole[k]


def test_edit_cost_is_least_over_all_paths():
    def slow(a, b):
        from functools import lru_cache

        @lru_cache(None)
        def f(i, j):
            if not i and not j:
                return 0.0
            best = 1e9
            if i:
                best = f(i - 1, j) + (0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0)
            if j:
                best = min(best, f(i, j - 1) + (0.5 if b[j - 1] in "aeiou" or (i and j > 1 and b[j - 1] == b[j - 2]) else 1.0))
            if i and j:
                best = min(best, f(i - 1, j - 1) + (0 if a[i - 1] == b[j - 1] else 0.4 if (a[i - 1], b[j - 1]) in phrases.LOOKALIKE else 1.0))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                best = min(best, f(i - 2, j - 2) + 0.7)
            return best

        return f(len(a), len(b))

    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abe1l") for _ in range(rng.randrange(7))) for _ in range(2))
        assert abs(phrases.edit_cost(a, b, 99) - slow(a, b)) < 1e-9, (a, b)
        assert phrases.least_cost(phrases.bag(a), phrases.bag(b)) <= slow(a, b) + 1e-9, (a, b)
        for least in (0.55, 0.7):
            assert phrases.likeness(a + "s", b, least) == phrases.likeness(a + "s", b, least, (phrases.bag(a + "s"), phrases.bag(b)))


def test_labels_table(spark):
    aliases = spark.createDataFrame(ENTRIES + [(None, "x"), ("z", None)], "canonical string, normalized_alias string")
    rows = [(1, ["uper arm", None, " ", "violin bow"], "k"), (2, None, None), (3, [], ""), (4, ["UPER  ARM"], "k"), (4, ["UPER  ARM"], "k"), (5, ["upper arm " + "blah " * 2000], "k")]
    df = spark.createDataFrame(rows, "output_id bigint, unresolved_tokens array<string>, phrase string").withColumn("canonical", F.lit("clash"))
    got = sorted((r.output_id, r.token_no, r.canonical) for r in phrases.canonical_labels(df, aliases).collect())
    assert got == [(1, 0, "upper_arm"), (1, 1, "unmatched"), (1, 2, "unmatched"), (1, 3, "unmatched"), (4, 0, "upper_arm"), (4, 0, "upper_arm"), (5, 0, "unmatched")]
    assert phrases.canonical_labels(df.limit(0), aliases).count() == 0
    assert {r.canonical for r in phrases.canonical_labels(df, aliases.limit(0)).collect()} == {"unmatched"}
    report = {r.canonical: (r.n_phrases, r.n_outputs) for r in phrases.unmatched_report(df, aliases).collect()}
    assert report == {"upper_arm": (3, 2), "unmatched": (4, 2)}


def test_blocks_of_a_long_reference_list_agree_with_one(spark):
    typed = spark.createDataFrame([(t,) for t in ("uper arm", "wlking crutch", "leg over knee", "violin bow", "lfet hand side")], "phrase string")
    entries = spark.createDataFrame(ENTRIES, "canonical string, text string")
    one = {r.phrase: (r.canonical, r.score) for r in phrases.map_phrases(typed, entries).collect()}
    for size in (1, 3):
        many = {r.phrase: (r.canonical, r.score) for r in phrases.map_phrases(typed, entries, max_entries=size).collect()}
        assert many.keys() == one.keys()
        assert all(many[p][0] == c and (c == "unmatched" or abs(many[p][1] - s) < 1e-12) for p, (c, s) in one.items())
    assert one["wlking crutch"][0] == "crutch"


def test_words_that_say_nothing_are_told_by_their_company(spark):
    """A word beside many different words of the list says nothing; one that only stands beside its own companion does."""
    names = [f"{a}{b}" for a in ("bor", "kel", "mav", "tun", "zid", "hof", "pex", "wug") for b in ("ander", "istol", "ecume", "uffin", "omega")]
    entries = spark.createDataFrame([(n, n) for n in names], "canonical string, text string")
    typed = [f"{n} hurrah" for n in names] + [f"{n} hurrah {n[:3]}" for n in names] + [f"hurrah {n} {m}" for n, m in zip(names, names[1:])] + [f"quilted {i} jackal" for i in range(60)] + ["quilted jackal"]
    got = {r.phrase: r.canonical for r in phrases.map_phrases(spark.createDataFrame([(t,) for t in typed], "phrase string"), entries).collect()}
    assert all(got[f"{n} hurrah"] == n for n in names) and got["quilted jackal"] == "unmatched"
