import random

import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import pairs

PROMPT = "Sheet AB-123. Look at the marked person, find the limb section in question and return the letters of tiles that belong to it."
DEUTSCH = "Betrachte die markierte Person auf Blatt AB-123 und nenne alle Kacheln, deren Gerät zum betroffenen Abschnitt gehört."

OWN = [
    (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("​", "empty"), ("null", "empty"), ("{}", "empty"), ('""', "empty"), ("''", "empty"), ("```json\n```", "empty"), ("...", "empty"), ('{"choices": null}', "empty"),
    ("[]", ""), ('{"choices": []}', ""), ("None", ""), ("A", ""), ("A, C", ""), ("Pick B", ""), ("None of the shown devices fits.", ""), ("None of the shown devices fits", ""),
    ("The left thigh is affected, so A fit best", ""), ("I see a hook, hence C and D", ""), ('```json\n{"choices": ["A"]}\n```', ""), ("I cannot see a hook on the other side, therefore B remain for the left calf.", ""),
    ("I am not able to read the plate, still A are the ones made for the right calf.", ""), ("Sorry for the detour: the liner belongs to the left calf, hence B.", ""), ("Unfortunately the crop is dark; even so, it points to D.", ""),
    ('{"choices": ["A", "', "truncated"), ('```json\n{"choices": ["A"]}', "truncated"), ("Only A show a dev", ""), ("The left calf is affected, so A fit best because of", "truncated"), ("I take A and the", "truncated"),
    ("Some sheets call it “Unter", "truncated"), ("The options (A and B fit.", "truncated"), ("- A fits\n- B fits\n- ", "truncated"), ("1. A\n2. B\n3.", "truncated"), ("<b>A fits.", "truncated"), ("A fits,", "truncated"),
    ("I'm sorry, but I can't help with judging a person's body.", "refusal"), ("I have to pass on this request", "refusal"), ('{"choices": [], "note": "I must decline to evaluate medical images."}', "refusal"),
    ("Leider kann ich zu Körpermerkmalen keine Auskunft geben.", "refusal"), ("Malheureusement, je ne peux pas évaluer le corps d’une personne.", "refusal"), ("Lo siento, no puedo valorar el cuerpo de nadie.", "refusal"),
    ("I can't help with judging a person, but C fits.", ""),
]


@pytest.mark.parametrize("text,defect", OWN)
def test_defects_without_prompt(text, defect):
    assert pairs.own_defect(text)[0] == defect


def test_languages():
    assert pairs.language(PROMPT) == "en" and pairs.language(DEUTSCH) == "de"
    assert pairs.language("La zone touchée est le genou gauche, donc G conviennent le mieux.") == "fr"
    assert pairs.language("Se ve un tubo en el brazo izquierdo, por eso elijo A y C.") == "es"
    assert pairs.language("Vê-se um tubo no braço esquerdo, por isso fico com X.") == "pt"
    assert pairs.language("Het gaat om de linker kuit, dus A passen het best.") == "nl"
    assert pairs.language("На изображении показана левая нога человека") == "cyrillic"
    assert pairs.language("Pick A") == "" and pairs.language("") == ""
    assert pairs.language(pairs.sentences_of('Some sheets call it “Unterschenkel der Person”; here the left calf carries a tube, so I take A.')) == "en"


def brute_tile(a, b, least=3):
    """Greedy string tiling by looking at every pair of places each time."""
    used_a, used_b = set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return len(used_a)
        k, i, j = best
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))


def test_tiling_covers_what_brute_force_covers():
    rng = random.Random(2)
    for _ in range(60):
        b = [str(i) for i in range(12)]  # no repeats: one round is all there is
        a = [rng.choice(b + ["x", "y"]) for _ in range(14)] if rng.random() < 0.3 else b[rng.randrange(6) :] + ["x"] + b[: rng.randrange(6)]
        seen = set()
        a = [t for t in a if not (t in seen or seen.add(t))]
        assert pairs.tile(a, b)[0] == brute_tile(a, b)
    assert pairs.tile(["p", "q", "r"] * 2, ["p", "q", "r"]) == (6, 3)


def test_copies():
    words = lambda t: pairs.TOKEN.findall(t.casefold())
    q = words(PROMPT)
    for text in (PROMPT, PROMPT.upper(), "Q: " + PROMPT, PROMPT + "\n" + PROMPT, PROMPT[:-30], "\n".join([PROMPT] * 2000), PROMPT.replace(",", " ").replace(".", "")):
        assert pairs.copies(words(text), q), text
    for text in ("A", "The marked person needs A.", "find the limb section", PROMPT[:40], DEUTSCH):
        assert not pairs.copies(words(text), q), text
    assert not pairs.copies([], q) and not pairs.copies(words(PROMPT), [])


PRED = "delivery_id bigint, item_id string, model_id string, raw_text string, choices array<string>, parse_error int, prompt string, item_row int"
ITEM = "item_row bigint, item_id string, query struct<template_id:string,text:string>, raw_text string, deleted_at timestamp"


def test_table(spark):
    items = spark.createDataFrame([(1, "a:1", ("t", PROMPT), "z", None), (2, "a:2", ("t", DEUTSCH), "z", None), (3, "a:3", None, "z", None), (4, "a:1", ("t", "other"), "z", None), (5, None, ("t", PROMPT), "z", None)], ITEM)
    rows = [
        (1, " A:1", "m", PROMPT), (2, "a:2", "m", PROMPT), (3, "a:9", "m", PROMPT), (4, None, "m", PROMPT), (5, "a:3", "m", DEUTSCH), (6, "a:1", "m", "Man sieht, dass der linke Arm endet, deshalb wähle ich C."), (7, "a:2", None, "Man sieht, dass der linke Arm endet, deshalb wähle ich C."),
        (8, None, None, None), (9, "a:1", "m", "A, B"), (10, "a:1", "m", '{"choices": ["A", "'), (11, "a:1", "m", "word. " * 30_000), (12, "a:1", "m", "a " + "(" * 50_000), (1, " A:1", "m", PROMPT), (13, "a:2", "m", "Answer: B"),
    ]
    df = spark.createDataFrame([(*r, None, 0, "clash", 3) for r in rows], PRED)
    got = sorted((r.delivery_id, r.defect) for r in pairs.broken_pairs(df, items).collect())
    assert got == [(1, "copies_question"), (1, "copies_question"), (2, "other_language"), (6, "other_language"), (8, "empty"), (10, "truncated"), (12, "truncated")]
    assert pairs.broken_pairs(df.limit(0), items).count() == 0
    alone = {r.delivery_id: r.defect for r in pairs.broken_pairs(df, items.limit(0)).collect()}
    assert alone == {8: "empty", 10: "truncated", 12: "truncated"}
    report = {(r.model, r.defect): r.n for r in pairs.defect_report(df.where("delivery_id <> 1"), items).collect()}
    assert report[(None, "empty")] == 1 and report[("m", "truncated")] == 2


def test_one_item_with_most_rows(spark):
    items = spark.createDataFrame([(1, "hot", ("t", PROMPT), "", None), (2, "cold", ("t", DEUTSCH), "", None)], ITEM)
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("item_id"), F.lit("Man sieht, dass der linke Arm endet, deshalb wähle ich C.").alias("raw_text")).withColumnRenamed("id", "delivery_id")
    assert pairs.broken_pairs(df, items).count() == 1333


OTHER = [("图中可以看到左腿的假肢。", "han"), ("画像には左足の義足が見えます。", "kana"), ("เห็นขาเทียมข้างซ้ายชัดเจน", "thai"), ("На изображении показана левая нога", "cyrillic"), ("왼쪽 다리가 보입니다", "hangul"), ("Φαίνεται το αριστερό πόδι", "greek")]


@pytest.mark.parametrize("text,script", OTHER)
def test_scripts_without_blanks(text, script):
    assert pairs.tongue(text) == script and pairs.own_defect(text)[1] == script


def test_answers_in_another_script(spark):
    """One clause without blanks is enough, and two scripts differ from each other."""
    assert pairs.tongue("Pick A") == "" and pairs.tongue("A, B 腿") == "" and pairs.tongue(PROMPT) == "en"
    items = spark.createDataFrame([(1, "en", ("t", PROMPT), "", None), (2, "zh", ("t", OTHER[0][0]), "", None), (3, "ru", ("t", OTHER[3][0]), "", None)], ITEM)
    asked = [(f"{item}{k}", item, text) for item in ("en", "zh", "ru") for k, (text, _) in enumerate(OTHER)]
    rows = [(n, item, text + " 左腿 A。" if k == "zh0" else text + " A.") for n, (k, item, text) in enumerate(asked)]
    df = spark.createDataFrame(rows, "delivery_id bigint, item_id string, raw_text string")
    got = {r.delivery_id for r in pairs.broken_pairs(df, items).collect() if r.defect == "other_language"}
    assert got == {n for n, (k, _, _) in enumerate(asked) if k not in ("zh0", "ru3")}
