"""Answers of other domains and wordings than the test tables': written by hand, none of them made by a generator."""

import pytest

from gaugeloom.llm import pairs

REFUSED = [
    "I'm afraid I can't answer that.", "I am sorry, but I cannot provide medical advice.", "As an assistant I am not allowed to give an opinion on that.", "I won't do that.", "I'd rather not say.", "We are not in a position to comment on individual cases.",
    "Sorry, I can't assist with that request.", "I do not feel comfortable judging people by their looks.", "I will not be answering this question.", "I have to respectfully decline.", "I must refuse.", "That goes beyond my capabilities.", "This violates my guidelines, sorry.",
    "It is not appropriate for me to guess someone's age.", "I don't have permission to share this information.", "I cannot help you choose between A and D.", "Unfortunately, I'm unable to process this picture.", "I am not qualified to diagnose patients.", "I couldn't possibly comment.",
    "My instructions do not allow me to discuss this topic.", "No recommendation can be given here.", "I refuse to answer.", "I can't make that decision for you.", "I would prefer not to speculate on this.", "I am not authorized to rank these candidates.",
    "Ich möchte dazu keine Stellungnahme abgeben.", "Das kann ich leider nicht beantworten.", "Ich bin nicht befugt, darüber Auskunft zu geben.", "Meine Richtlinien verbieten mir das.", "Wir dürfen hierzu keine Aussagen treffen.", "Dabei kann ich Ihnen nicht helfen.",
    "Je ne peux malheureusement pas vous aider.", "Je préfère ne pas me prononcer.", "Il ne m'est pas possible de répondre à cette question.", "Je refuse de répondre.", "No puedo responder a esa pregunta.", "Prefiero no opinar sobre esto.", "Me niego a contestar.",
    "Não posso comentar este assunto.", "Prefiro não responder.", "Infelizmente não consigo ajudar com isso.", "Daar kan ik niet bij helpen.", "Ik weiger deze vraag te beantwoorden.", "Ik mag hierover geen uitspraak doen.",
    "Purtroppo non posso rispondere a questa domanda.", "Preferisco non esprimere un giudizio.", "Mi rifiuto di rispondere.", "Non mi è possibile valutare questa immagine.",
]
ANSWERED = [
    "The train does not stop here, so take B.", "I can't see the left edge well, but it looks like a cup.", "No, the battery is not included.", "You should not open the valve before the pump stops.", "I would pick the green one, not the red one.", "None of them is correct.", "The policy covers water damage.",
    "It cannot be A, because A is too long.", "He refused the offer, so the answer is C.", "They could not agree on a price.", "I do not see any difference between them; both fit.", "The guidelines recommend two doses a day.", "I am not sure, but B seems right.", "There is nothing on the table.", "She would rather walk than drive.",
    "The answer lies outside the city, near the river.", "I have never seen this bird; the beak suggests a finch.", "We can rule out the first two.", "Not enough light falls on the plate to read it, yet the shape is that of a spoon.", "The machine won't start unless the lid is closed.", "Der Zug hält hier nicht.", "Ich sehe keine Schraube, also passt B.",
    "Die Richtlinien nennen zwei Stufen.", "Je ne vois pas la vis, donc c'est la deuxième.", "Il ne pleut pas.", "No veo el tornillo, por eso elijo C.", "No hay pan en la mesa.", "Não vejo o parafuso, por isso escolho C.", "Não chove.", "Ik zie de schroef niet, dus kies ik C.", "Het regent niet.", "Non vedo la vite, quindi scelgo C.", "Non piove.",
    "I can't tell the two apart, so I pick A and C.", "I was not able to read the label, still D is the closest match.", "Do not use this on wet floors.", "Can you not hear the engine? It is the pump.", "The shop does not sell bread.", "It would not be cheaper to rent.", "My terms are simple: cash only.",
]


def rates(hits, positives, alarms):
    return hits / positives, hits / max(1, hits + alarms)


def test_unseen_refusals():
    recall, precision = rates(sum(map(pairs.is_refusal, REFUSED)), len(REFUSED), sum(map(pairs.is_refusal, ANSWERED)))
    assert recall >= 0.9 and precision >= 0.9, ([t for t in REFUSED if not pairs.is_refusal(t)], [t for t in ANSWERED if pairs.is_refusal(t)])


WHOLE = [
    "The answer is the purple car", "We recommend the second device", "It was a nice day in Paris and the patient walked home", "The best option is hook", "Answer: carbon fibre blade", "I know what it is", "This is the house they were looking for, which we know what it was made for", "Put the kettle on", "He came in", "Yes", "Option two",
    "Sie fährt morgen nach Hause zurück", "Das Gerät passt gut", "Il habite à Lyon depuis dix ans", "Elle mange une pomme verte", "Vive en una casa grande", "Ela mora numa casa grande", "Hij woont in een groot huis", "Vive in una casa grande", "It costs 20", "The tube is 5\" wide and fits", "I like it :(", "图中可以看到左腿的假肢", "Она живёт в Москве",
]
BROKEN = [
    "The house stands on the", "He said that", "We went to Paris, London and", "because of", "The reason is that the pump, which", "Sie fährt nach Hause, weil", "Das Gerät gehört zu dem", "Il habite dans une", "Elle mange une pomme et", "Vive en una casa con", "Ela mora numa casa de", "Hij woont in een", "Vive in una casa con", "First, ", "The colours are:", "He said “come",
    "[1, 2, 3", '{"a": {"b": 1}', "```python\nprint(1)", "- one\n- two\n-", "It is (as far as we know", "<p><b>bold", "The car was", "What we need is the",
]


def test_unseen_endings():
    """No full stop is needed; what binds to a next word or is open breaks off."""
    hits, alarms = [pairs.is_truncated(t) for t in BROKEN], [pairs.is_truncated(t) for t in WHOLE]
    recall, precision = rates(sum(hits), len(BROKEN), sum(alarms))
    assert recall >= 0.9 and precision >= 0.9, ([t for t, h in zip(BROKEN, hits) if not h], [t for t, h in zip(WHOLE, alarms) if h])


ITEM = "item_row bigint, item_id string, query struct<template_id:string,text:string>"
PREDICTION = "delivery_id bigint, item_id string, raw_text string"


def test_words_cut_off_are_told_by_other_texts(spark):
    """A last word that only begins what others say in full after the same word breaks off; a new word is whole."""
    items = spark.createDataFrame([(1, "i", ("t", "Where does the river flow and what does the old bridge carry today?"))], ITEM)
    said = ["The river carries sand to the harbour, and the bridge carries trains.", "The bridge carries trains over the river.", "The harbour lies where the river meets the sea."] * 5
    tails = {100: "The bridge carries trai", 101: "The river carries sand to the harb", 102: "The river carries sand to the car", 103: "The bridge carries trains", 104: "The bridge carries trains over the ri", 105: "The bri", 106: "The harbour lies where the river", 107: "The bridge carries lorries"}
    rows = [(k, "i", t) for k, t in enumerate(said)] + [(k, "i", t) for k, t in tails.items()]
    got = {r.delivery_id: r.defect for r in pairs.broken_pairs(spark.createDataFrame(rows, PREDICTION), items).collect()}
    assert got == {100: "truncated", 101: "truncated", 104: "truncated", 105: "truncated"}
    again = {r.delivery_id: r.defect for r in pairs.broken_pairs(spark.createDataFrame(rows * 3, PREDICTION).repartition(7), items).collect()}
    assert again == got


LANGUAGES = [
    ("Jag bor i en liten stad och det finns en park som ligger nära huset.", "sv"), ("Mieszkam w małym mieście, które leży nad rzeką, ale nie mam samochodu.", "pl"), ("Der Hund schläft unter dem Tisch und die Katze auf dem Stuhl.", "de"), ("Le chien dort sous la table et le chat sur la chaise.", "fr"),
    ("El perro duerme debajo de la mesa y el gato en la silla.", "es"), ("O cão dorme debaixo da mesa e o gato na cadeira.", "pt"), ("De hond slaapt onder de tafel en de kat op de stoel.", "nl"), ("Il cane dorme sotto il tavolo e il gatto sulla sedia.", "it"), ("The dog sleeps under the table and the cat on the chair.", "en"),
    ("Pes spí pod stolem a kočka je na židli, která stojí u okna.", "cs"), ("Собака спит под столом.", "cyrillic"), ("狗在桌子下面睡觉。", "han"), ("犬はテーブルの下で寝ています。", "kana"), ("الكلب ينام تحت الطاولة", "arabic"), ("הכלב ישן מתחת לשולחן", "hebrew"), ("कुत्ता मेज के नीचे सोता है", "devanagari"),
]


@pytest.mark.parametrize("text,name", LANGUAGES)
def test_unseen_languages(text, name):
    assert pairs.tongue(text) == name


def test_foreign_without_a_known_language():
    """Eight words without a single closed-class word of the prompt's language are another language."""
    text = "Mbwa analala chini ya meza na paka juu kiti"
    assert pairs.tongue(text) == "" and pairs.foreign(text, "", "en") and not pairs.foreign("Dog sleeps", "", "en") and not pairs.foreign(text, "", "")
    for names in ("red car, blue bike, green bus, yellow tram, grey van", "steel\nwood\nglass\npaper\nstone\ncopper\nwool\nleather\nplastic", "A: hook (carbon), B: shell (foam), C: strap (nylon), D: blade (titanium)"):
        assert not pairs.foreign(names, pairs.tongue(names), "en")
    assert pairs.foreign("犬は寝ています", "kana", "cyrillic") and not pairs.foreign("x", "en", "en")


def test_no_word_is_lost_to_the_counts_before_tiling():
    """480 copied words of a prompt of 600 and 120 others are a copy; long texts are tiled whole, in one sweep."""
    prompt = [f"w{i}" for i in range(600)]
    assert pairs.copies(prompt[:480] + [f"z{i}" for i in range(120)], prompt)
    assert not pairs.copies(prompt[:470] + [f"z{i}" for i in range(130)], prompt)
    assert pairs.tile(prompt * 300, prompt) == (180_000, 600)
