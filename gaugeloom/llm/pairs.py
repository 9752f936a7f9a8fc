"""Broken prompt and response pairs: each defective answer with its kind of defect."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import clean_id, salted_join, shuffle_partitions, written

# Closed word classes by language, in lower case. ``link`` words bind to what follows (articles,
# determiners, prepositions, conjunctions, relative pronouns), so no sentence ends with them; ``be`` are copulas and
# auxiliaries; ``other`` are pronouns, particles and adverbs that only help to tell the language.
LINK = {
    "en": "the a an of to and or but nor if than because although while whereas since unless until that which who whose whom this these every each my your his her its their our at by for from into onto with without within between among during toward towards upon as so both either",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber sondern denn weil dass daß ob wenn als zu zum zur im in ins am an auf mit von vom bei für aus nach über unter durch gegen ohne um zwischen deren dessen welche welcher welches mein dein sein ihr unser kein keine keinen jede jeder jedes",
    "fr": "le la les l un une des du de d et ou mais car que qui dont où au aux en dans sur sous avec sans pour par entre vers chez ce cet cette ces mon ma mes ton ta son sa ses leur leurs notre votre si comme parce chaque aucun aucune",
    "es": "el la los las un una unos unas y e o u a pero sino porque que si cuando como al del de en con sin por para entre sobre desde hasta hacia su sus mi mis este esta estos estas ese esa cuyo cuya cada ningún ninguna",
    "pt": "o a os as um uma uns umas e ou mas porque que se quando como ao aos à às do da dos das de no na nos nas em com sem por pelo pela para entre sobre desde até seu sua seus suas este esta cujo cuja cada nenhum nenhuma",
    "nl": "de het een en of maar want omdat dat die als wanneer te ten ter in op aan met van bij voor uit naar door over onder tussen zonder om mijn zijn haar hun ons deze dit elke ieder geen",
    "it": "il lo la i gli le un uno una e o ma perché che se quando come al allo alla ai agli alle del dello della dei degli delle di da dal nel nella in con senza su sul sulla per tra fra suo sua suoi questo questa quel cui ogni nessun nessuna",
    "sv": "en ett och eller men att som om när för i på av till med från utan under över mellan den det de min din sin vår varje ingen inget",
    "da": "en et og eller men at som om når for i på af til med fra uden under over mellem den det de min din sin vores hver ingen",
    "no": "en ei et og eller men at som om når for i på av til med fra uten under over mellom den det de min din sin vår hver ingen",
    "pl": "i oraz lub albo ale że który która które jeśli gdy w we na z ze do od po przy bez dla przez między nad pod o ten ta te mój jego jej ich każdy żaden",
    "cs": "a nebo ale že který která které jestliže když v ve na z ze do od po při bez pro přes mezi nad pod o ten ta to můj jeho její jejich každý žádný",
    "fi": "ja tai mutta että joka jotka jos kun kuin koska tämä tuo se ne minun sinun hänen jokainen",
    "hu": "a az egy és vagy de hogy ami aki amely ha mert mint ez ezek minden",
    "ro": "un o și sau dar că care dacă când în la de cu fără pe pentru din între acest această fiecare niciun",
    "tr": "ve veya ama ki eğer gibi için ile bir bu şu her hiçbir",
}
BE = {
    "en": "is are was were be been am has have had do does did can will would should may must could might shall",
    "de": "ist sind war waren wird werden wurde wurden hat haben kann können soll muss darf",
    "fr": "est sont était étaient sera seront a ont peut peuvent doit",
    "es": "es son era eran fue será está están ha han puede pueden debe",
    "pt": "é são era eram foi será está estão tem têm pode podem deve",
    "nl": "is zijn was waren wordt worden werd heeft hebben kan kunnen moet mag",
    "it": "è sono era erano fu sarà ha hanno può possono deve",
    "sv": "är var har hade kan ska måste", "da": "er var har havde kan skal må", "no": "er var har hadde kan skal må", "pl": "jest są był była było ma może", "cs": "je jsou byl byla bylo má může",
    "fi": "on ovat oli voi pitää", "hu": "van volt lehet kell", "ro": "este sunt era au are poate", "tr": "var yok",
}
OTHER = {
    "en": "it i we you he she they there here not no none only also then therefore hence still yet even what how where when all any some out up over best them me us",
    "de": "ich wir sie er es man sich nicht nur auch noch deshalb daher also hier dort alle am",
    "fr": "je j nous vous il elle ils elles on ne pas se y plus donc seules seule tous toutes quoi mieux",
    "es": "yo nosotros usted ellos se no lo le les más mejor solo sólo también así aquí todas todos qué cuál",
    "pt": "eu nós você eles se não mais melhor só somente também assim aqui então isso todas todos qual",
    "nl": "ik wij je hij zij u men zich niet alleen ook nog daarom dus hier daar alle wat",
    "it": "io noi voi loro si non più meglio solo anche così qui tutte tutti quale lo",
    "sv": "jag vi du han hon inte också bara här där alla därför så", "da": "jeg vi du han hun ikke også kun her der alle derfor så", "no": "jeg vi du han hun ikke også bare her der alle derfor så",
    "pl": "ja my nie się tylko też tutaj tam więc dlatego wszystkie jak co", "cs": "já my ne se jen také zde tam proto tedy všechny jak co", "fi": "minä me ei vain myös tässä siellä siksi kaikki", "hu": "én mi nem csak is itt ott ezért minden",
    "ro": "eu noi nu se doar și aici acolo deci toate", "tr": "ben biz değil sadece de da burada orada bütün",
}
# Letters that few languages write.
TELLING = {"de": "ß", "es": "ñ¿¡", "pt": "ãõ", "pl": "łżźśćńąę", "cs": "řěů", "hu": "őű", "ro": "țşșă", "tr": "ğı", "fr": "œ"}
WORDS_OF = {k: frozenset(f"{LINK[k]} {BE[k]} {OTHER[k]}".split()) for k in LINK}
SPOKEN_WITH: dict[str, tuple[str, ...]] = {w: tuple(k for k in sorted(WORDS_OF) if w in WORDS_OF[k]) for w in frozenset().union(*WORDS_OF.values())}
LINKS = {k: frozenset(v.split()) for k, v in LINK.items()}
COPULAS = {k: frozenset(v.split()) for k, v in BE.items()}
LINKS[""] = frozenset().union(*(LINKS[k] for k in ("en", "de", "fr", "es", "pt", "nl", "it")))  # of texts too short to tell
COPULAS[""] = frozenset()
QUESTION_WORDS = frozenset("what which who whom where how that when why".split())

# Refusals: who declines, how, and what, in lower case.
_ACT_EN = r"(?:help|assist|answer|respond|repl|choos|pick|select|decid|judg|assess|evaluat|comment|describ|identif|analy[sz]|rat(?:e|ing)\b|rank|discuss|shar(?:e|ing)\b(?! the)|provid|giv|offer|say|speak|process|continu|compl|fulfil|recommend|suggest|nam(?:e|ing)\b|engag|participat|proceed|advis|determin|do (?:this|that|so|it)\b|mak(?:e|ing) (?:\w+ )?(?:claim|statement|judge?ment|choice|selection|assessment|decision|guess)|guess|interpret|examin|diagnos|support)"
_ADV_EN = r"(?:(?:really|simply|just|currently|unfortunately|therefore|also|at this time|be|even|fully|possibly|in good conscience) )*"
_NEG_EN = (
    r"(?:(?:am|are|'m|'re|was|is)(?: \w+)? (?:not (?:able|allowed|permitted|going|willing|authori[sz]ed|qualified|designed|equipped|comfortable|in a position)(?: to| with)?|unable to|forbidden to|not to)"
    r"|(?:can|could|will|would|may|must|shall|should|do|did)(?: ?not|n't)(?: (?:have (?:the |any )?(?:ability|capability|permission|authori[sz]ation|right|means) to|feel (?:comfortable|able)(?: to)?|want to|wish to))?|can't|won't|cannot"
    r"|(?:(?:would|'d) )?(?:rather not|prefer not to)|(?:(?:must|have to|need to|will|'ll|shall|respectfully|politely) )*(?:decline|refuse|abstain from|refrain from|avoid)(?: to)?|(?:lack|have no) (?:the |any )?(?:ability|capability|permission|right) to)"
)
_ACT_DE = r"(?:beurteil|bewert|komment|beschreib|beantwort|antwort|helf|einschätz|auswähl|wähl|entscheid|analys|identif|äußer|weiterhelf|unterstütz|verarbeit|empfehl|nennen|sagen|geben|treffen|machen)"
_NOUN_DE = r"(?:auskunft|auskünfte|aussagen?|angaben?|antwort(?:en)?|bewertung|einschätzung|auswahl|empfehlung|urteil|stellungnahme|meinung)"
_ACT_FR = r"(?:évaluer|juger|commenter|décrire|répondre|aider|donner|choisir|prononcer|analyser|sélectionner|identifier|traiter|faire (?:cela|ça|ce choix)|fournir|recommander|me prononcer|décider|dire|accéder)"
_ACT_ES = r"(?:valorar|opinar|juzgar|comentar|describir|responder|contestar|ayudar|evaluar|elegir|escoger|seleccionar|dar|analizar|identificar|procesar|recomendar|decidir|hacer (?:eso|esto)|pronunciar|ofrecer|decir)"
_ACT_PT = r"(?:avaliar|opinar|julgar|comentar|descrever|responder|ajudar|escolher|selecionar|dar|analisar|identificar|processar|recomendar|decidir|fazer (?:isso|isto)|pronunciar|oferecer|dizer)"
_ACT_NL = r"(?:beoordel|help|beantwoord|antwoord|beschrijv|kiez|kies|selecter|analyser|identificer|verwerk|aanbevel|beslis|zeggen|geven|uitspreken|doen)"
_ACT_IT = r"(?:valutare|giudicare|commentare|descrivere|rispondere|aiutar|scegliere|selezionare|dare|fornire|analizzare|identificare|elaborare|raccomandare|decidere|pronunciarmi|esprimere|fare (?:questo|ciò)|dire)"
# What every form of a language's refusal holds some of, and its forms: a clause refuses if one stands in it.
REFUSALS = {
    "en": (
        "not n't unable declin refus abst refrain avoid lack pass have prefer rather forbid nothing something given made offered provided polic guideline rules principles terms instructions against violat contrary place outside beyond".split(),
        [
            rf"\b(?:i|we)(?: (?:really|simply|therefore|also|regretfully|respectfully|politely))? ?{_NEG_EN} {_ADV_EN}{_ACT_EN}",
            r"\b(?:i|we) (?:must|have to|need to|will) (?:respectfully |politely )?(?:decline|refuse|pass\b|abstain)",
            r"\b(?:i|we)(?: would|'d)? (?:prefer (?:not to|to (?:leave|skip|pass))|rather not)\b",
            r"\b(?:no|any) (?:selection|answer|choice|comment|assessment|judge?ment|recommendation)s? (?:will|can|could|may|shall) (?:not )?be (?:given|made|offered|provided)\b",
            r"\b(?:nothing|not something|isn't something|is not something|something) (?:that )?(?:i|we)(?: may| can|'m able to| am able to| will|'d| would)(?: rather not| not|n't)?(?: help| say| do| comment| discuss| answer)",
            r"\b(?:policy|policies|guidelines?|rules|principles|terms|instructions) (?:\w+ )?(?:forbids?|prohibits?|prevents?|bars?|stops?|(?:do(?:es)? not|don't|doesn't|won't|will not) (?:allow|permit|let))\b|\b(?:against|violates?|contrary to) (?:my|our) (?:policy|policies|guidelines|rules|principles)\b",
            r"\b(?:would|will|is|'s) ?(?:not be|not|n't be|n't) (?:appropriate|right|proper|ethical|possible) for (?:me|us)\b|\bnot (?:appropriate|possible) for (?:me|us)\b|\bnot my place to\b|\binappropriate for (?:me|us)\b",
            r"\b(?:outside|beyond) (?:of )?(?:what (?:i|we) (?:do|can|may)|my (?:scope|abilities|capabilities|role|remit)|the scope of what)\b",
        ],
    ),
    "de": (
        "kein nicht ablehn lehne verweiger passen richtlinien regeln vorgaben".split(),
        [
            rf"\b(?:ich|wir) (?:\w+ ){{0,3}}?(?:kann|können|darf|dürfen|möchte|möchten|werde|will|muss)\b.*(?:\bkeinerlei\b|\bkeine?[nr]? {_NOUN_DE}|\bnicht\b.*{_ACT_DE}|ablehnen|verweigern|passen$)|\b(?:kann|können|darf|dürfen|möchte|möchten|werde|muss) (?:ich|wir)\b.*(?:\bkeinerlei\b|\bkeine?[nr]? {_NOUN_DE}|\bnicht\b.*{_ACT_DE}|ablehnen|verweigern)",
            r"\bich (?:kann|darf|bin) (?:\w+ )*nicht (?:in der lage|befugt|berechtigt)\b|\bich bin nicht (?:in der lage|befugt|berechtigt)\b|\bich lehne (?:es|das|dies)?\b.*\bab\b|\b(?:richtlinien|regeln|vorgaben) (?:verbieten|untersagen|erlauben)\b|\bist mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)\b",
        ],
    ),
    "fr": (
        "pas refuse décliner préfère m'abst m'est interdi permet".split(),
        [
            rf"\bje (?:ne |n')(?:peux|puis|dois|veux|souhaite|suis|saurais) (?:malheureusement )?(?:pas |pas en mesure d[e'] ?|pas autorisée? à )?(?:vous |me |y |en )?{_ACT_FR}",
            r"\bje (?:dois|préfère) (?:refuser|décliner|ne pas|m'abstenir)\b|\bje refuse de\b|\bil ne m'est pas (?:permis|possible)\b|\bje ne suis pas (?:en mesure|autorisée?|capable)\b|\bmes (?:règles|consignes|directives) (?:m'interdisent|interdisent|ne me permettent)",
        ],
    ),
    "es": (
        "no rechaz declin negar niego absten normas políticas directrices".split(),
        [
            rf"\bno (?:puedo|debo|quiero|podemos|podré|me está permitid[oa]|me es posible|estoy en condiciones de|soy capaz de|estoy autorizad[oa] a|se me permite) ?{_ACT_ES}",
            r"\b(?:debo|tengo que|he de) (?:rechazar|declinar|negarme|abstenerme)\b|\bprefiero no\b|\bme niego a\b|\bmis (?:normas|políticas|directrices) (?:prohíben|no me permiten|me impiden)",
        ],
    ),
    "pt": (
        "não recus declin abster regras diretrizes normas".split(),
        [
            rf"\bnão (?:posso|devo|quero|podemos|poderei|me é permitido|me é possível|estou autorizad[oa] a|sou capaz de|consigo) ?{_ACT_PT}",
            r"\b(?:devo|tenho de|tenho que) (?:recusar|declinar|abster)|\bprefiro não\b|\brecuso-me a\b|\bas minhas (?:regras|diretrizes|normas) (?:proíbem|não me permitem|não permitem)",
        ],
    ),
    "nl": (
        "niet geen weiger afwijz richtlijnen regels".split(),
        [
            rf"\bik (?:\w+ ){{0,2}}?(?:kan|mag|wil|zal|moet)\b.*(?:\bniet\b.*{_ACT_NL}|\bgeen (?:oordeel|antwoord|uitspraak|keuze|mening|commentaar|advies|informatie)\b|weigeren|afwijzen)|\b(?:kan|mag|wil|zal|moet) ik\b.*(?:\bniet\b.*{_ACT_NL}|\bgeen (?:oordeel|antwoord|uitspraak|keuze|mening|commentaar|advies)\b|weigeren)|\bik ben niet in staat\b|\bik weiger\b|\b(?:richtlijnen|regels) (?:verbieden|staan niet toe)\b|\bis mij niet toegestaan\b",
        ],
    ),
    "it": (
        "non rifiut declin astener regole guida norme".split(),
        [
            rf"\bnon (?:posso|devo|voglio|possiamo|potrò|mi è (?:permesso|possibile|consentito)(?: di)?|sono (?:in grado|autorizzat[oa]|capace) (?:di|a)|riesco a|intendo) ?(?:\w+ )?{_ACT_IT}",
            r"\b(?:devo|mi vedo costretto a) (?:rifiutare|declinare|astenermi|rifiutarmi)\b|\bpreferisco non\b|\bmi rifiuto di\b|\ble mie (?:regole|linee guida|norme) (?:vietano|non mi permettono|mi impediscono)",
        ],
    ),
}
REFUSAL = [(tuple(stems), re.compile("|".join(f"(?:{r})" for r in forms))) for stems, forms in REFUSALS.values()]
#: Where one clause ends and another may take back what it says.
CLAUSES = re.compile(r"[.;!?\n{}]+|,?\s+(?:but|however|yet|still|though|nevertheless|aber|doch|jedoch|trotzdem|mais|cependant|pero|sin embargo|mas|porém|maar|toch|ma|però)\s+|,\s+(?:so|hence|therefore|thus|daher|also|donc|así que|então|dus|quindi)\s+")

#: JSON answers that are whole and hold no sentence, with or without a fence; the JVM leaves them out.
WHOLE_JSON = r'(?s)^\s*(?:```(?:json)?\s*)?\{\s*"choices?"\s*:\s*(?:\[\s*(?:"[A-Za-z0-9 ]+"\s*(?:,\s*"[A-Za-z0-9 ]+"\s*)*)?\]|"[A-Za-z0-9 ]+")\s*\}(?:\s*```)?\s*$'
#: Bare option letters, as a list or by blanks.
BARE_LETTERS = r"^\s*[A-Z](?:\s*(?:,|;|/|\s)\s*[A-Z])*\.?\s*$"

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
TOKEN = re.compile(r"[^\W_]+")
WORD_GAP = re.compile(r"([^\W_]+(?:['’-][^\W_]+)*)((?:\W|_)*)")
CLOSING = re.compile(r"[.!?…,;:)”»\"]")
MARKS = re.compile(r"[,;:.!?/\n()\[\]|•]+")
SENTENCE_GAP = re.compile(r"[.!?]\s|\n")
OPEN = {"{": "}", "[": "]", "(": ")", "“": "”", "«": "»", "„": "“"}
CLOSERS = {"}", "]", ")", "”", "»"}
PIECE = re.compile(r'```|\\.|(?<=\d)"(?!\w)|[:;=]-?[()]|["{}\[\]()“”«»„]|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|\n')
BLANK = re.compile(r"[\s​-‏⁠﻿­]+")
FENCED = re.compile(r"```[a-zA-Z]*")
LETTER = re.compile(r"[A-H](?<![\w'’-].)(?![\w'’-])")  # the letter first: it is rare, so most places are passed over at once
QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"")
OBJECT = re.compile(r"```[\s\S]*?(?:```|$)|\{[^{}]*\}?")
SENTENCE_END = ".!?…。！？"
PENDING = "?"  # the text alone does not tell whether it breaks off


def parse_open(text: str) -> list[str]:
    """Pushdown parse of fences, brackets, quotations and markup; the closers still awaited at the end.

    Closers that nothing awaits are passed over. Inside a double quotation only its end
    counts. Inch marks and faces like ``:(`` open nothing. A list whose last entry is empty
    awaits an ``item``.
    """
    stack: list[str] = []
    for m in PIECE.finditer(text):
        c = m.group()
        top = stack[-1] if stack else ""
        if c[0] == "\\":
            continue
        if top == '"':
            if c == '"':
                stack.pop()
        elif c == "```":
            if "```" in stack:
                while stack.pop() != "```":
                    pass
            else:
                stack.append(c)
        elif c == '"':
            if m.start() == 0 or not text[m.start() - 1].isdigit():
                stack.append(c)
        elif c == top and c in ("“",):
            stack.pop()
        elif c in OPEN:
            stack.append(OPEN[c])
        elif c in CLOSERS:
            if c in stack:
                while stack.pop() != c:
                    pass
        elif c[0] == "<" and not c.endswith("/>"):
            tag = c.strip("</>").split()[0].lower()
            if c[1] == "/":
                if f"<{tag}>" in stack:
                    while stack.pop() != f"<{tag}>":
                        pass
            elif tag not in ("br", "hr", "img", "p", "li"):
                stack.append(f"<{tag}>")
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s*$", text) and text.strip(" \n-*•.)0123456789"):
        stack.append("item")
    return stack


def is_empty(text: str | None) -> bool:
    """No answer content: nothing but blanks, fences, quotation marks, punctuation, or an empty JSON value."""
    if text is None:
        return True
    bare = BLANK.sub(" ", FENCED.sub(" ", text)).strip()
    if not bare:
        return True
    if bare == "[]" or re.fullmatch(r"\[\s*\]", bare):
        return False
    if bare[0] in '{"n' or bare == "''":
        try:
            v = json.loads(bare)
        except ValueError:
            v = "" if bare == "''" else bare
        if v is None or v == "" or v == {}:
            return True
        if isinstance(v, dict):
            return all(x is None or x == "" or x == {} for x in v.values())
        if isinstance(v, str):
            return not v.strip()
    return not any(ch.isalnum() for ch in bare) and not re.search(r"[\[\]{}]", bare)


def sentences_of(text: str) -> str:
    """The text without JSON objects, fenced blocks and quotations."""
    return QUOTED.sub(" ", OBJECT.sub(" ", text)).strip()


#: Names of letters in Unicode that begin otherwise than the script, which Japanese and Chinese share.
SHARED = {"CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "KATAKANA-HIRAGANA": "kana", "HALFWIDTH": "kana", "IDEOGRAPHIC": "han"}


SCRIPTS: dict[str, str] = {}  # known scripts, by the letter


def letter_script(c: str) -> str:
    """Script of a letter, by its name in Unicode, in lower case."""
    if c not in SCRIPTS:
        SCRIPTS[c] = _letter_script(c)
    return SCRIPTS[c]


def _letter_script(c: str) -> str:
    name = unicodedata.name(c, "")
    if name.startswith("FULLWIDTH LATIN") or "ORDINAL INDICATOR" in name or name.startswith("MICRO SIGN"):
        return "latin"
    if name.startswith("HALFWIDTH HANGUL"):
        return "hangul"
    first = name.split(" ")[0]
    return SHARED.get(first, first.lower())


def script_of(text: str) -> str:
    """Name of the script that most letters besides option letters are in, empty if that is Latin or there are under two others.

    Chinese characters count as Japanese beside kana. Words don't matter, as not all scripts part them.
    """
    if text.isascii() or max(text) < "ɐ":
        return ""
    letters = [c for c in LETTER.sub(" ", text) if c.isalpha()]
    other = [c for c in letters if not (c < "ɐ" or "Ḁ" <= c < "ἀ")]
    if len(other) < 2 or (len(letters) - len(other)) * 2 >= len(letters):
        return ""
    counts = Counter(map(letter_script, other))
    if counts["kana"]:
        counts["kana"] += counts.pop("han", 0)
    return max(counts, key=lambda k: (counts[k], k))


def plain_words(text: str) -> list[str]:
    """Words besides option letters, in lower case, parted at hyphens and apostrophes."""
    return TOKEN.findall(LETTER.sub(" ", text).lower())


def language(text: str) -> str:
    """Language of the sentences by words of closed classes and telling letters; the script's name for other scripts; empty if undecided.

    Fewer than four words besides option letters are no sentence in Latin script. Two words
    in ten must be of the language's closed classes, and more than of any other.
    """
    script = script_of(text)
    if script:
        return script
    words = plain_words(text)
    if len(words) < 4:
        return ""
    score: dict[str, float] = {}
    for w in words:
        for k in SPOKEN_WITH.get(w, ()):
            score[k] = score.get(k, 0.0) + 1
    if not score:
        return ""
    if not text.isascii():
        written_with = set(text.lower())
        for k, letters in TELLING.items():
            if k in score and not written_with.isdisjoint(letters):
                score[k] += 0.5
    best, *others = sorted(score, key=lambda k: (-score[k], k))
    return best if score[best] >= 2 and (not others or score[best] > score[others[0]]) and score[best] >= 0.2 * len(words) else ""


def tongue(text: str) -> str:
    """The script's name for other scripts than Latin, else the language; empty if undecided."""
    return language(text)


def foreign(text: str, spoken: str, asked: str) -> bool:
    """The sentences are in another language than the prompt's.

    spoken and asked are as of ``language``. Sentences whose language is not known are foreign
    if eight different words or more hold none of the closed classes of the prompt's language,
    and seven of them or more follow each other without a mark: lists of names are no sentences.
    """
    if spoken or not asked:
        return bool(asked) and spoken != asked
    if asked not in WORDS_OF:  # Latin letters under a prompt in another script: only words of a known language are sentences
        return False
    words = plain_words(text)
    if len(set(words)) < 8 or any(w in WORDS_OF[asked] for w in words):
        return False
    return any(len(set(plain_words(part))) >= 7 for part in MARKS.split(text))


def tile(a: list[str], b: list[str], least: int = 3) -> tuple[int, int]:
    """Greedy string tiling: the longest runs of a that stand in b first, none over another; covered tokens of a and of b.

    A run of b may be used for several of a, so that a text given twice counts twice. The
    longest run from each place of a comes from one sweep over the equal places; a heap then
    hands the runs out, a run cut short by a longer one goes back with what is left of it.
    """
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    runs: list[tuple[int, int, int]] = []
    after: dict[int, int] = {}
    for i in range(len(a) - 1, -1, -1):
        after = {j: after.get(j + 1, 0) + 1 for j in where.get(a[i], ())}
        if after:
            j = max(after, key=lambda j: (after[j], -j))
            if after[j] >= least:
                runs.append((-after[j], i, j))
    heapq.heapify(runs)
    free, of_b = [True] * len(a), set()
    while runs:
        n, i, j = heapq.heappop(runs)
        k = 0
        while k < -n and free[i + k]:
            k += 1
        if k == -n:
            free[i : i + k] = [False] * k
            of_b.update(range(j, j + k))
        elif k >= least:
            heapq.heappush(runs, (-k, i, j))
    return free.count(False), len(of_b)


def copies(answer: list[str], prompt: list[str]) -> bool:
    """The answer is nothing but the prompt, or most of it: four fifths of its words tile at least half of the prompt.

    Words that the other side lacks cannot be tiled, so a count of them spares most tilings.
    """
    if len(answer) < 4 or not prompt:
        return False
    asked, given = set(prompt), set(answer)
    if sum(w in asked for w in answer) < 0.8 * len(answer) or sum(w in given for w in prompt) < 0.5 * len(prompt):
        return False
    of_answer, of_prompt = tile(answer, prompt)
    return of_answer >= 0.8 * len(answer) and of_prompt >= 0.5 * len(prompt)


def _pair(words: list[str], at: int) -> tuple[str, str]:
    """The word before a place, in short form, and the word there."""
    short = lambda w: "#" if len(w) == 1 and w.isupper() or w.isdigit() else w.lower()
    return short(words[at - 1]) if at else "^", words[at].lower()


def tail_of(text: str, spoken: str) -> tuple[str, str, str]:
    """(state, word before, last word) of how a text ends.

    state: ``truncated`` if something opened is not closed, or it ends with a comma, a word that
    binds to what follows (articles, prepositions, conjunctions; copulas, unless a question word
    took their object before), or a lone small letter. Empty if it ends with an end mark, an
    option letter, a number or a word in another script than Latin: the end mark alone may be
    missing. Else ``PENDING``: the word may be whole or cut off, which only other texts can tell.
    """
    if parse_open(text):
        return "truncated", "", ""
    last = text.rstrip()
    if not last or last[-1] in SENTENCE_END or last[-1] in "`}])”»\"'":
        return "", "", ""
    if last[-1] in ",;:-–—/":
        return "truncated", "", ""
    tail = re.split(r"(?<=[.!?])\s+|\n", last)[-1]
    words = WORD.findall(tail)
    if not words or not last.endswith(words[-1]):
        return "", "", ""
    end = words[-1]
    if re.fullmatch(r"[A-Z]", end) or not end[-1].isalpha() or script_of(end + end):
        return "", "", ""
    if len(words) == 1 and end[0].isupper() and end.lower() in ("none", "keine", "keiner", "aucune", "aucun", "ninguna", "ninguno", "nenhuma", "nenhum", "geen", "nessuna", "nessuno"):
        return "", "", ""
    language_of = spoken if spoken in LINKS else ""
    low = end.lower()
    if len(end) == 1:
        return "truncated", "", ""
    if low in LINKS[language_of] or low in COPULAS[language_of]:
        clause = [w.lower() for w in WORD.findall(re.split(r"[,;:]", tail)[-1])]
        before = clause[:-1]
        bound = not before or before[-1] in LINKS[language_of] or before[-1] in QUESTION_WORDS
        asks = language_of == "en" and any(w in QUESTION_WORDS for w in before[:-1]) and (low in COPULAS["en"] or low in STRANDED)
        if bound or not asks:
            return "truncated", "", ""
        return "", "", ""
    before, word = _pair(words, len(words) - 1)
    return PENDING, before, word


# English prepositions that may end a clause with a question word.
STRANDED = frozenset("of to for from with by at into".split())


def is_truncated(text: str, spoken: str | None = None) -> bool:
    """The text by itself breaks off; a last word that only other texts can show to be cut off counts as whole."""
    return tail_of(text, language(sentences_of(text)) if spoken is None else spoken)[0] == "truncated"


def word_pairs(text: str) -> list[tuple[str, str, bool]]:
    """(word before, word, closes) of every word of the sentences that something follows: another word, or a mark after which a clause is whole."""
    out, before = [], "^"
    for word, gap in WORD_GAP.findall(text.rstrip()):
        low = word.lower()
        if gap:
            out.append((before, low, gap != " " and bool(CLOSING.search(gap))))
        before = "^" if gap != " " and SENTENCE_GAP.search(gap) else "#" if len(word) == 1 and word.isupper() or word.isdigit() else low
    return out


def is_refusal(text: str) -> bool:
    """A clause refuses, and no other clause chooses an option.

    Options named in the refusing clause itself are what it refuses to choose from.
    """
    low = text.lower().replace("’", "'")
    forms = [form for stems, form in REFUSAL if any(x in low for x in stems)]
    if not forms:
        return False
    refuses = False
    for clause in CLAUSES.split(text.replace("’", "'")):
        low = clause.lower()
        hit = next((m for form in forms if (m := form.search(low))), None)
        if hit is None:
            if any(not re.match(r"A [a-z]", clause[m.start() :]) for m in LETTER.finditer(clause)):
                return False
        else:
            refuses = True
            if re.search(r"[\w'],\s+(?:[A-H]\b(?! [a-z])|(?:option|tile) [A-H]\b)", clause[hit.end() :]):
                return False
    return refuses


def own_defect(text: str | None) -> tuple[str, str]:
    """(defect that needs no prompt and no other texts, language of the sentences)."""
    if is_empty(text):
        return "empty", ""
    plain = sentences_of(text)
    spoken = tongue(plain) if plain else ""
    if is_refusal(text):
        return "refusal", spoken
    return ("truncated" if is_truncated(text, spoken) else ""), spoken


WHOLE_SEEN = 20  # how often a pair of words must be seen before its never closing a clause tells anything
RARELY = 0.005  # a share under which something counts as never


def cut_tails(tails: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key) of the ends of texts that break off, by what all texts show.

    tails: (spoken, before, word, n) of texts that end with a word and no mark. pairs: (spoken,
    before, word, inside, closing), how often the pair goes on, and closes a clause. A tail
    breaks off if its word is the beginning of longer words seen after the same word, and is
    itself hardly ever seen whole there; or if the pair is often seen to go on and never closes.
    Tails of texts too short to tell the language are compared with the pairs of all languages.
    """
    keys = ["spoken", "before", "word"]
    ends = tails.groupBy(*keys).agg(F.sum("n").alias("n"))
    own = pairs.groupBy(*keys).agg(F.sum("inside").alias("inside"), F.sum("closing").alias("closing"))
    seen = own.where("spoken <> ''").unionByName(own.groupBy(F.lit("").alias("spoken"), "before", "word").agg(F.sum("inside").alias("inside"), F.sum("closing").alias("closing")))
    begun = seen.select("spoken", "before", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("short"), "word", (F.col("inside") + F.col("closing")).alias("whole"))
    begun = begun.where("short <> word").groupBy("spoken", "before", F.col("short").alias("word")).agg(F.sum("whole").alias("longer"))
    known = ends.join(seen, keys, "left").join(begun, keys, "left").fillna(0, ["inside", "closing", "longer"])
    whole = F.col("inside") + F.col("closing")
    cut = (F.col("longer") > 0) & (whole <= RARELY * F.col("longer")) & (whole <= F.col("n"))
    goes_on = (F.col("inside") >= WHOLE_SEEN) & (F.col("closing") <= RARELY * F.col("inside")) & (F.col("n") <= 0.2 * F.col("inside"))
    return known.where(cut | goes_on).select(F.concat_ws("\x01", *keys).alias("key"))


PAIR_LIMIT = 400_000  # distinct pairs a task holds before it passes them on


def broken_pairs(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """(delivery_id, defect) of predictions whose answer is defective; at most one defect each.

    Order: empty, copies_question, refusal, truncated, other_language. Whole JSON answers and
    bare option letters hold no sentence and are left out by a JVM filter; all other texts
    are parsed whole, in Arrow batches. Prompts come from the item of the same identifier
    (case and outer white space do not matter; of several rows the smallest item_row counts,
    whether the item is deleted or not); heavy items are salted in that join. Null texts are
    empty; null item_ids and items without prompt leave the last two defects out. Repeated
    deliveries count each. Empty tables give an empty result; further columns are ignored.

    Whether a last word without a mark after it is whole is told by all answers and prompts
    together (``cut_tails``): the same pass counts their pairs of words, which are combined per
    task and written to the shared folder with the rows that are defective or still open.
    """
    spark = predictions.sparkSession
    prompts = (
        items.select(clean_id(F.col("item_id")).alias("_key"), "item_row", F.col("query.text").alias("prompt"))
        .where("_key is not null and prompt is not null").groupBy("_key").agg(F.min_by("prompt", "item_row").alias("prompt"))
    )
    answers = predictions.select("delivery_id", F.coalesce(clean_id(F.col("item_id")), F.lit("")).alias("_key"), "raw_text").where(
        F.col("raw_text").isNull() | ~(F.col("raw_text").rlike(WHOLE_JSON) | F.col("raw_text").rlike(BARE_LETTERS))
    )
    joined = salted_join(answers, prompts, "_key", ["delivery_id"], "left", partitions=shuffle_partitions(spark)).select("delivery_id", "raw_text", "prompt")
    names = ["delivery_id", "defect", "spoken", "before", "word", "inside", "closing"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def judge(batches):
        own: dict = {}
        asked: dict = {}
        pairs: dict = {}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        def learn(spoken, text, n):
            for before, word, closes in word_pairs(text):
                counts = pairs.setdefault((spoken, before, word), [0, 0])
                counts[closes] += n

        def pass_on(everything):
            if everything or len(own) > 50_000:
                for entry in own.values():
                    if entry[3]:
                        learn(entry[1], entry[3], entry[5])
                own.clear()
            if everything or len(pairs) > PAIR_LIMIT:
                rows = [(None, None, *k, *n) for k, n in pairs.items()]
                pairs.clear()
                for i in range(0, len(rows), 10_000):
                    yield batch(rows[i : i + 10_000])

        for b in batches:
            yield from pass_on(False)
            if len(asked) > 20_000:
                asked.clear()
            out = []
            for i, text, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                entry = own.get(text)
                if entry is None:
                    if is_empty(text):
                        entry = ["empty", "", [], "", None, 0]
                    else:
                        plain = sentences_of(text)
                        spoken = tongue(plain) if plain else ""
                        state, before, word = ("refusal", "", "") if is_refusal(text) else tail_of(text, spoken)
                        entry = [state, spoken, TOKEN.findall(text.casefold()), plain, (before, word), 0]
                    own[text] = entry
                entry[5] += 1
                defect, spoken, words, plain, end, _ = entry
                if defect != "empty" and prompt is not None:
                    if prompt not in asked:
                        asked[prompt] = TOKEN.findall(prompt.casefold()), tongue(prompt)
                        learn(asked[prompt][1], prompt, 1)
                    prompt_words, prompt_language = asked[prompt]
                    if copies(words, prompt_words):
                        defect = "copies_question"
                    elif defect in ("", PENDING) and plain and foreign(plain, spoken, prompt_language):
                        if not defect:
                            defect = "other_language"
                        else:
                            out.append((i, "other_language", spoken, *end, None, None))
                            continue
                if defect == PENDING:
                    out.append((i, None, spoken, *end, None, None))
                elif defect:
                    out.append((i, defect, None, None, None, None, None))
            yield batch(out)
        yield from pass_on(True)

    judged = written(joined.mapInArrow(judge, "delivery_id bigint, defect string, spoken string, before string, word string, inside bigint, closing bigint"))
    sure = judged.where("delivery_id is not null and word is null").select("delivery_id", "defect")
    still = judged.where("delivery_id is not null and word is not null").select("delivery_id", "defect", "spoken", "before", "word")
    cut = cut_tails(still.select("spoken", "before", "word", F.lit(1).alias("n")), judged.where("delivery_id is null").select("spoken", "before", "word", "inside", "closing"))
    keyed = still.select("delivery_id", "defect", F.concat_ws("\x01", "spoken", "before", "word").alias("key"))
    told = salted_join(keyed, cut.withColumn("_cut", F.lit(True)), "key", ["delivery_id"], "left")
    return sure.unionByName(told.select("delivery_id", F.when(F.col("_cut"), "truncated").otherwise(F.col("defect")).alias("defect")).where("defect is not null"))


def defect_report(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """(model, defect, n): defective answers per model, models compared as identifiers."""
    found = broken_pairs(predictions, items)
    models = predictions.select("delivery_id", clean_id(F.col("model_id")).alias("model"))
    return found.join(models, "delivery_id").groupBy("model", "defect").agg(F.count(F.lit(1)).alias("n"))
