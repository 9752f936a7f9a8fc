import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeloom.llm import encodings, leaks, mixing


def brute_leaks(docs, passages):
    grams = {}
    for e, p in passages:
        w = leaks.words_of(p or "")
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(e)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t or "")
        for i in range(len(w) - 11):
            out |= {(d, e) for e in grams.get(tuple(w[i : i + 12]), ())}
    return out


def test_search_finds_every_leak(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(120)] + ["the", "of", "left"] * 30
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))) for i in range(60)]
    docs = []
    for d in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        if d % 3 == 0:
            w = passages[rng.randrange(60)][1].split()
            n = rng.choice([11, 12, 13, 40])
            at = rng.randrange(max(1, len(w) - n + 1))
            cut = rng.randrange(len(words) + 1)
            words[cut:cut] = w[at : at + n]
        docs.append((d, rng.choice([" ", "-", "\n ", ", "]).join(words).upper() if d % 2 else " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("eval_id", F.lit(1)).withColumn("passage", F.lit("x"))
    p = spark.createDataFrame(passages, "eval_id bigint, passage string")
    want = brute_leaks(docs, passages)
    assert len(want) > 50
    assert {(r.doc_id, r.eval_id) for r in leaks.leaked_passages(d, p).collect()} == want
    one = sorted(map(tuple, leaks.leaked_passages(d, p).collect()))
    for size in (1, 25):  # many indexes, documents' windows routed to them: the same runs, each counted once
        assert sorted(map(tuple, leaks.leaked_passages(d, p, max_passages=size).collect())) == one


def test_routes_of_equal_runs_are_equal():
    """Every run of known words lies in exactly one segment, and its route depends on its words alone."""
    import numpy as np

    rng = random.Random(11)
    held = np.zeros(leaks.SLOTS, np.int64)
    vocabulary = [f"v{i}" for i in range(40)]
    for w in vocabulary[:36]:
        held[leaks.slots_of([w])[0]] = rng.randrange(1, 6)
    routes = {}
    for _ in range(300):
        words = [rng.choice(vocabulary) if rng.random() < 0.1 else rng.choice(vocabulary[:36]) for _ in range(rng.randrange(0, 60))]
        seen = Counter()
        for route, start, end in leaks.segments(words, held):
            for i in range(start, end - 11):
                run = tuple(words[i : i + 12])
                seen[i] += 1
                counts = [(held[s], s) for s in leaks.slots_of(list(run))]
                assert route == min(counts)[1] == routes.setdefault(run, route)
        assert seen == {i: 1 for i in range(len(words) - 11) if all(w in vocabulary[:36] for w in words[i : i + 12])}


def test_one_route_with_most_of_the_corpus(spark):
    """A boilerplate run in every document: its index is repeated and its documents salted; nothing is lost."""
    text = " ".join(f"b{i}" for i in range(14))
    p = spark.createDataFrame([(e, text if e < 3 else " ".join(f"p{e}x{i}" for i in range(20))) for e in range(40)], "eval_id bigint, passage string")
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.lit(" "), F.col("id").cast("string")).alias("text"))
    got = leaks.leaked_passages(d, p, max_passages=8).groupBy("eval_id").agg(F.count("*").alias("n"), F.sum("n_runs").alias("r")).collect()
    assert {r.eval_id: (r.n, r.r) for r in got} == {0: (3000, 9000), 1: (3000, 9000), 2: (3000, 9000)}


def test_leak_edges(spark):
    text = "Ärzte größer " + " ".join(f"n{i}" for i in range(12))
    p = spark.createDataFrame([(1, text), (2, None), (3, "too short"), (4, ""), (1, text), (None, text)], "eval_id bigint, passage string")
    docs = [(1, text.upper()), (2, None), (3, ""), (4, "x " * 40_000 + text), (5, " ".join(text.split()[:11])), (1, text.upper()), (6, text.replace(" ", "_"))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.eval_id, r.n_runs) for r in leaks.leaked_passages(d, p).collect()) == [(1, 1, 6), (4, 1, 3), (6, 1, 3)]
    assert leaks.leaked_passages(d.limit(0), p).count() == 0 and leaks.leaked_passages(d, p.limit(0)).count() == 0
    assert {r.eval_id: r.n_documents for r in leaks.leak_report(d, p).collect()} == {1: 3}


def test_search_scores_like_a_full_scan():
    rng = random.Random(9)
    passages = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(40))) for i in range(200)]
    index = leaks.PassageIndex(passages)
    for _ in range(100):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))]
        score = Counter()
        for t in set(words):
            if t in index.postings:
                for k, w in zip(*index.postings[t][:2]):
                    score[k] += w
        assert sorted(index.search(words)) == sorted(k for k, s in score.items() if s >= 1)


# ---- mixing

def documents(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if i % 3 else rng.choice(["mid", "small", "none", None])
        text = " ".join(rng.choice(["alpha", "beta", "größe", "x1"]) for _ in range(rng.randrange(1, 60))) if i % 11 else "same text"
        rows.append((i, None if i % 97 == 5 else text, source))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("place", F.lit(0)).withColumn("n_tokens", F.lit(-1)), rows


def targets(spark, rows=(("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.2, 3))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_limits_and_whole_texts(spark):
    df, rows = documents(spark)
    m = mixing.Mixture(df, targets(spark), buckets=16)
    chosen = m.chosen().collect()
    texts = {i: (t, s) for i, t, s in rows}
    tokenizer = mixing.load_tokenizer(mixing.TOKENIZER)
    assert len({(texts[r.doc_id][1], texts[r.doc_id][0]) for r in chosen}) == len(chosen)  # a text once per source
    assert all(r.n_tokens == len(tokenizer.encode_ordinary(texts[r.doc_id][0])) and r.source == texts[r.doc_id][1] for r in chosen)
    limit, share = {"big": 1, "mid": 4, "small": 3}, {"big": 0.5, "mid": 0.3, "small": 0.2}
    assert all(1 <= r.copies <= limit[r.source] for r in chosen)
    size = Counter()
    for r in chosen:
        size[r.source] += r.n_tokens * r.copies
    total, longest = sum(size.values()), max(r.n_tokens for r in chosen)
    assert all(abs(size[s] - share[s] * m.total) <= longest for s in share)
    shares = {r.source: r for r in m.shares().collect()}
    assert all(abs(shares[s].share - size[s] / total) < 1e-9 and shares[s].tokens == size[s] for s in share)
    # One source is used up: no greater size keeps every limit.
    assert any(abs(r.budget - r.available * r.max_repeats) < 1e-6 for r in shares.values())
    again = mixing.Mixture(df.repartition(7), targets(spark), buckets=64).chosen()
    assert sum(r.copies for r in again.collect()) > 0
    blocks = m.blocks().collect()
    assert Counter((r.doc_id, r.block) for r in blocks).most_common(1)[0][1] == 1 and len(blocks) == sum(r.copies for r in chosen)


def test_partial_pass_is_a_prefix_of_a_fixed_order(spark):
    df, _ = documents(spark, 3)
    a = {(r.doc_id, r.copies) for r in mixing.Mixture(df, targets(spark), buckets=8).chosen().collect()}
    b = {(r.doc_id, r.copies) for r in mixing.Mixture(df.repartition(5), targets(spark), buckets=8).chosen().collect()}
    assert a == b


def test_mixture_edges(spark):
    df, _ = documents(spark, n=30)
    assert mixing.Mixture(df.limit(0), targets(spark)).chosen().count() == 0
    assert mixing.Mixture(df, targets(spark).limit(0)).shares().count() == 0
    m = mixing.Mixture(df, targets(spark, [("big", 0.5, 2), ("absent", 0.5, 9), (None, 0.1, 1), ("mid", None, None)]))
    got = {r.source: (round(r.share, 6), r.most_copies) for r in m.shares().collect()}
    assert got == {"big": (1.0, 2), "absent": (0.0, 0), "mid": (0.0, 0)}
    long = spark.createDataFrame([(1, "word " * 60_000, "big"), (2, "", "big"), (2, "", "big")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in mixing.Mixture(long, targets(spark, [("big", 1.0, 1)])).chosen().collect()} == {1, 2}


def test_temperature_meets_the_entropy_or_the_repeat_limit():
    tokens, loose = [1000, 300, 50, 0], [100] * 4
    for wanted in (0.3, 0.7, 1.0, 1.09):
        shares, total, a = mixing.temper(tokens, loose, 1350.0, wanted)
        assert abs(mixing.entropy(shares) - wanted) < 1e-9 and total == 1350.0 and abs(sum(shares) - 1) < 1e-12 and shares[3] == 0.0
        assert all(abs(s / shares[0] - (n / 1000) ** a) < 1e-9 for s, n in zip(shares[:3], tokens))
    shares, total, a = mixing.temper(tokens, [2] * 4, 1350.0, 1.0)  # the smallest source may come twice at most
    assert abs(total - 1350.0) < 1e-6 and abs(shares[2] * total - 2 * 50) < 1e-6 and mixing.entropy(shares) < 1.0 and 0 < a < 1
    shares, total, a = mixing.temper(tokens, [1] * 4, 5000.0, 1.0)  # more than there is
    assert total <= 1350.0 * (1 + 1e-12) and all(s * total <= n * (1 + 1e-9) for s, n in zip(shares, tokens))
    assert mixing.temper([0, 0], [1, 1], 10.0, 0.5) == ([0.0, 0.0], 0.0, 1.0)


@pytest.mark.skipif(not __import__("pathlib").Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_reached_shares_of_the_tables(spark):
    """Each source's share is its target's but for a text, within the repeat limit; blocks hold the chosen copies, each once."""
    from gaugeloom.llm import queries

    d = "/root/testdata/sf0.01"
    rows = queries.p9_shares(spark, d).collect()
    assert len(rows) == 10 and abs(sum(r.target_share for r in rows) - 1) < 1e-9
    assert all(abs(r.share - r.target_share) < 0.01 and r.most_copies <= r.max_repeats for r in rows)
    mix = {(r.doc_id, k) for r in queries.p9_mix(spark, d).collect() for k in range(r.copies)}
    blocks = queries.p9_blocks(spark, d).collect()
    assert {(r.doc_id, r.block) for r in blocks} == mix and len(blocks) == len(mix)
    tempered = queries.p9_tempered(spark, d).collect()
    assert all(r.most_copies <= r.max_repeats and abs(r.share - r.weight) < 0.01 for r in tempered) and 0 < tempered[0].exponent != 1.0


def test_cut_is_the_same_for_any_number_of_buckets(spark):
    """Whatever the buckets, as many tokens as the budget asks for are used, to the nearest text."""
    docs = spark.createDataFrame([(i, "s" if i % 3 else "t", f"word{i} " * (i % 9 + 1)) for i in range(600)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("s", 0.5, 3), ("t", 0.5, 2)], "source string, target_share double, max_repeats int")
    for buckets in (1, 2, 64):
        rows = {r.source: r for r in mixing.Mixture(docs, targets, buckets=buckets).shares().collect()}
        assert all(abs(r.tokens - r.budget) <= 40 and r.most_copies <= r.max_repeats for r in rows.values())


def test_bisection():
    shares, total, a = mixing.solve_weights([100, 10], [0.5, 0.5], [1, 2])
    assert (shares, total, a) == ([0.5, 0.5], 40.0, 1.0)
    shares, total, a = mixing.solve_weights([100, 10], [0.5, 0.5], [1, 2], total=80)
    assert 0 < a < 1 and abs(shares[1] * 80 - 20) < 1e-6 and abs(sum(shares) - 1) < 1e-9
    shares, total, a = mixing.solve_weights([100, 10], [0.5, 0.5], [1, 2], total=1000)
    assert a == 0 and abs(total - 110) < 1e-6
    shares, _, a = mixing.solve_weights([100, 100], [0.9, 0.1], [9, 9], total=50, least_entropy=0.6)
    assert 0 < a < 1 and abs(mixing.entropy(shares) - 0.6) < 1e-6
    assert mixing.solve_weights([0, 0], [0.5, 0.5], [1, 1])[1] == 0
    assert math.isclose(mixing.entropy([0.5, 0.5]), math.log(2))


# ---- encodings

SENTENCES = [
    "Le relecteur demande si le crochet à câble appartient à la personne ou au siège derrière elle.", "Die Größe des Ausschnitts beträgt 51 Bildpunkte, und die Länge bleibt unverändert.",
    "El tamaño del recorte es de 96 píxeles y la posición cambió muy poco después.", "A resposta vazia está correta, não há lâmina visível na região da panturrilha.",
]
CLEAN = SENTENCES + [
    "NÃO há lâmina. SITUAÇÃO DA AVALIAÇÃO TQ-080, PADRÃO", "Names on the tag: SÃO-87, ÂNGULO-56.", "Plate text: Łódka 26, Žába 135.", "The label reads «Опора-119» in full.", "On the box: 義肢 32.", "Scale note: Ω = 51, tolerance ±17.4.",
    "see about 30° rotation and 12 µm film, 12 ÷ 4 tiles, ½ of it — £5, © me", "“as shown” isn’t «ok»… façade naïve résumé", "¿pertenece la pinza? ¡No!", "AVEC SON CIRÉ SAFRAN, TÊTU", "plain ascii & more; a &b c", "", "n.º 5, 1ª vez", "Ça va, Été, Über, Óscar", "ét́",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert encodings.restore(text)[:2] == (False, text)


@pytest.mark.parametrize("text", SENTENCES)
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
def test_wrong_reading_is_undone(text, read):
    data = text.encode("utf-8")
    try:
        garbled = data.decode(read)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in data)
    found, restored, path, whole = encodings.restore(garbled)
    assert found and restored == text and whole and path
    found, restored, _, _ = encodings.restore("An introduction stays. " + garbled + " And an end.")
    assert found and restored == "An introduction stays. " + text + " And an end."


@pytest.mark.parametrize("sign", list("½ãâà°±÷£©µ«»"))
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_single_signs(sign, read):
    text = f"He mentions {sign} of the grid."
    assert encodings.restore(f"He mentions {sign.encode('utf-8').decode(read)} of the grid.")[:2] == (True, text)
    twice = sign.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252", "ignore")
    assert encodings.restore(f"Grade {twice} = 36.8, {twice} = 12.9.")[0]


@pytest.mark.parametrize("text", SENTENCES)
def test_twice_garbled(text):
    once = text.encode("utf-8").decode("latin-1")
    assert encodings.restore(once.encode("utf-8").decode("latin-1"))[1] == text


@pytest.mark.parametrize("read", ["cp1251", "cp437", "cp1253"])
def test_single_bytes_in_another_alphabet_are_found(read):
    assert encodings.restore(SENTENCES[2].encode("cp1252").decode(read))[0]


def test_lost_bytes_are_found_but_not_whole():
    found, text, _, whole = encodings.restore("Die Gr��e bleibt unver�ndert.")
    assert found and not whole and "�" in text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=40))
def test_any_text_ends(text):
    found, restored, path, whole = encodings.restore(text)
    assert found or restored == text


def test_table(spark):
    bad = SENTENCES[0].encode("utf-8").decode("cp1252", "replace")
    rows = [(1, bad), (2, SENTENCES[0]), (3, None), (4, ""), (1, bad), (5, "ok. " * 50_000 + bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("restored", F.lit("clash")).withColumn("whole", F.lit(1))
    got = sorted(r.doc_id for r in encodings.garbled_texts(df).collect())
    assert got == [1, 1, 5]
    assert encodings.garbled_texts(df.limit(0)).count() == 0


WEST = [
    "Le crochet est très près de la jambe, où la pièce a été posée.", "A pessoa não está na imagem e três peças são do braço.", "El niño y la niña no están en la imagen de la mañana.",
]


@pytest.mark.parametrize("text", WEST)
def test_western_letters_read_as_cp1250(text):
    """Each letter is usual in some language, but not in that of the text."""
    found, restored, path, _ = encodings.restore(text.encode("cp1252").decode("cp1250"))
    assert found and restored == text and "cp1250>cp1252" in path


@pytest.mark.parametrize("text", [*WEST, "The name on the plate is Dvořák and it was in the house of Kraków.", "Je to člověk, který má příliš žluťoučký kůň a není to on.", "Le texte de la photo dit « příliš žluťoučký kůň » et non autre chose.", "W tym zdaniu nie ma nic złego, ale są tu ogonki i żółć.", "Nu este nimic în imagine și mâna este a lui, dar să vedem ce are în față."])
def test_letters_that_fit_their_language_stay(text):
    assert encodings.restore(text)[:2] == (False, text)


def test_costly_texts_are_found_without_a_reading():
    text = "Zone ⣿a⣿b⣿c⣿d text."
    found, _, _, whole = encodings.restore(text)
    assert encodings.text_cost(text) >= encodings.UNRESTORED and found and not whole
