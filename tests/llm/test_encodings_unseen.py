"""Sentences of many languages, garbled in many ways and restored: texts are compared, not only found. None comes from the test tables."""

import pytest

from gaugeloom.llm import encodings

TEXTS = {
    "de": "Die Bäckerei öffnet früh, und die Brötchen sind über Nacht süß geworden.", "fr": "Le garçon a déjà mangé près de la forêt où il a rêvé l'été.", "es": "El niño pequeño comió piña y bebió café en el jardín.", "pt": "A irmã não quis pão, então o avô comeu maçã e feijão.",
    "pl": "Mała żółta łódź płynie po rzece, która jest w mieście i nie ma wody.", "cs": "Příliš žluťoučký kůň pěl ďábelské ódy, které nebyly v knize.", "tr": "Bu şehirde yaşayan insanlar için bir park ve çok güzel bir ağaç yok değil.", "hu": "Az őszi erdőben egy öreg tölgyfa és hűvös szél van, hogy így legyen.",
    "ru": "Сегодня утром шёл дождь, и мы остались дома читать книги о море.", "el": "Σήμερα ο καιρός είναι καλός και πάμε μια βόλτα στην πόλη.", "ja": "今日は天気がいいので、公園を散歩しました。本も読みました。", "zh": "今天天气很好，我们去公园散步，看见了很多花。",
}
GARBLINGS = [
    *[(lang, "utf-8", read) for lang in ("de", "fr", "es", "pt", "pl", "cs", "tr", "hu", "ru", "el") for read in ("cp1252", "latin-1", "mac_roman")], *[(lang, "utf-8", "cp437") for lang in ("de", "fr", "es", "pt")], ("ru", "utf-8", "cp1251"),
    *[(lang, "cp1252", read) for lang in ("de", "fr", "es", "pt") for read in ("mac_roman", "cp437", "cp850")], *[(lang, "mac_roman", "cp1252") for lang in ("de", "fr", "es", "pt")], *[(lang, "cp1250", "cp1252") for lang in ("pl", "cs")],
    ("tr", "cp1254", "cp1252"), *[("ru", w, r) for w, r in (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("koi8_r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"))],
    ("el", "cp1253", "latin-1"), ("el", "cp1253", "cp1252"), ("ja", "shift_jis", "cp1252"), ("ja", "shift_jis", "latin-1"), ("zh", "gbk", "cp1252"), ("zh", "gbk", "latin-1"),
]


def garbled(text, written, read):
    """The text's bytes read in another encoding; bytes without a character pass as control characters, as common readers do."""
    out = []
    for b in text.encode(written, "replace"):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_restored_text_of_unseen_garblings():
    found = restored = wrongly_whole = 0
    missed = []
    for lang, written, read in GARBLINGS:
        text = TEXTS[lang].encode(written, "replace").decode(written)
        is_garbled, got, _, whole = encodings.restore(garbled(text, written, read))
        found += is_garbled
        restored += got == text
        wrongly_whole += whole and got != text
        if got != text:
            missed.append((lang, written, read, got))
    assert found >= 0.98 * len(GARBLINGS) and restored >= 0.9 * len(GARBLINGS) and wrongly_whole <= 0.05 * len(GARBLINGS), (found, restored, wrongly_whole, len(GARBLINGS), missed)


SOUND = [
    *TEXTS.values(), "AT&amp;T said &lt;b&gt;", "caf&eacute; &euro; 5", "Þetta er íslenska og það er gott", "Tiếng Việt là ngôn ngữ của người Việt", "jäääär töööö", "Émile Zola à Noël, œuvre", "naïve façade — “quoted” text…", "5 µm ± 0.3 °C, 10 € für 2 m²", "Nº 5 1ª", "emoji 😀 👍🏽 ok", "한국어 텍스트입니다", "Ångström Öre", "« Oui », dit-il.", "שלום עולם", "مرحبا بالعالم",
]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert encodings.restore(text)[:2] == (False, text)


def test_pictures_and_single_letters():
    assert encodings.restore("ok 😀 thanks".encode().decode("cp1252"))[1] == "ok 😀 thanks"
    assert encodings.restore(garbled("Мы с братом и сестрой были в лесу", "cp1251", "latin-1"))[1] == "Мы с братом и сестрой были в лесу"


def test_dearest_states_are_bounded():
    """A text that nothing restores ends the search at its bound and is not called whole."""
    text = "Ž¼ÿ§Ðþ" * 300 + "�"
    found, _, _, whole = encodings.restore(text, max_states=300)
    assert found and not whole
