"""Text decoded with a wrong character encoding: found, and restored by best-first search."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.pairs import language
from gaugeloom.runtime import spread

#: Encodings a text may wrongly have been read with, and those it may have been written in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_15", "koi8_r", "cp866"]
WRITTEN_IN = ["utf-8", "cp1252", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "koi8_r", "cp866", "shift_jis", "gbk"]
GAIN = 1.0  # least fall of the cost for a text to count as garbled
UNRESTORED = 6.0  # a text of this cost counts as garbled even if no operation makes it cheaper
UPHILL = 1.0  # how much dearer than the text itself a first reading may be to be looked at; later ones are no dearer than the one before
STEPS = {"utf-8": 0.1, "unescape": 0.1, "gbk": 0.9, "shift_jis": 0.9}  # what reading anew costs; bytes that are UTF-8 are so hardly by chance
GUIDE = 0.25  # texts whose bytes were UTF-8 are looked at as if they cost so much less
STEP = 0.6  # what reading anew in another encoding costs
MAX_STATES = 3_000  # readings tried per document; where they do not do, the restored text is not called whole

RUN = re.compile(r"[^\x00-\x7f]+")
ENTITY = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")
QUOTES = frozenset("“”‘’«»„‹›—–…‑\xa0")
BESIDE = frozenset("°±½¼¾×÷§©®™€£¥¢²³¹ªº·¿¡†•")
# Letters beyond Latin-1 that languages written in Latin script use often.
USUAL = frozenset("œŒšŠžŽłŁńŃśŚźŹżŻćĆąĄęĘőŐűŰčČřŘěĚğĞışŞţŢăâîđĐůŮťďňľĺŕ")
SUSPECT = 0.8  # a character from this cost on makes its text worth a search


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


def _letter_cost(before: str, c: str, after: str) -> float:
    left, right = before.isalpha(), after.isalpha()
    kind, near = _script(c), [x for x in (before, after) if x.isalpha()]
    sign_follows = bool(after) and ord(after) > 127 and (not right or after in "µªº") and after not in QUOTES and not (after in "ªº" and c in "nN") and not ("\u3000" <= after < "\u3040" or "\uff00" <= after < "\uff61")
    if kind != "latin":
        if any(_script(x) == "latin" for x in near):
            return 3.0
        if sign_follows:
            return 2.0
        if c.isupper() and before.islower():
            return 2.0
        if kind == "other":
            return 0.4 if "\u4e00" <= c <= "\u9fff" and not _common_han(c) else 0.0
        usual = "а" <= c.lower() <= "я" or c in "ёЁ" or kind == "greek"
        if not near:
            return 1.0 if before.isdigit() or after.isdigit() else 0.1 if c in "аивкосуяієη" else 0.4  # words of one letter
        return 0.0 if usual else 0.8
    if any(_script(x) in ("greek", "cyrillic") for x in near):
        return 2.0
    if sign_follows:
        return 2.0
    if c.isupper():
        if before.islower() or (before.isupper() and after.islower()):
            return 2.0
        if not near:
            return 0.0 if before and before in "'’" or after and after in "'’-." else 0.7 if after == "\xa0" else 0.4
    elif before.isupper() and after.isupper():
        return 1.5
    return 0.0 if ord(c) < 0x100 or c in USUAL else 0.6


# Vowels of Cyrillic and Greek letters, in lower case.
VOWELS = frozenset("аеёиоуыэюяіїєўαάεέηήιίϊΐοόυύϋΰωώ")
CYRILLIC_WORD = re.compile("[\u0400-\u052f]+")
GREEK_WORD = re.compile("[\u0370-\u03ff\u1f00-\u1fff]+")
LATIN_STRETCH = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{3,}")
DOUBLED = frozenset("äöüõåéÄÖÜÕÅÉ")  # letters that some languages write three in a row
HALFWIDTH = re.compile("[\uff61-\uff9f]")


def _word_cost(word: str) -> float:
    """How implausible a word in Cyrillic or Greek letters is: no vowel, many consonants in a row, signs that cannot begin a word or stand there, several accents."""
    low, cost = word.lower(), 0.0
    if len(low) < 3:
        return 0.0
    if not word.isupper() and not any(c in VOWELS for c in low):
        cost += 0.6
    run = 0
    for c in low:
        run = 0 if c in VOWELS or c in "ьъ" else run + 1
        cost += 0.4 * (run > 4)
    if low[0] in "ьъы":
        cost += 1.0
    cost += sum(0.8 for i, c in enumerate(low) if c == "ъ" and not (i + 1 < len(low) and low[i + 1] in "еёюя"))
    vowels = 0
    for c in low:
        vowels = vowels + 1 if c in VOWELS else 0
        cost += 0.4 * (vowels > 3)
    accents = sum(c in "άέήίόύώΐΰ" for c in low)
    if "α" <= low[0] <= "ώ" or low[0] in "άέήίόύώ":
        cost += 0.8 * max(0, accents - 1) + (0.5 if "ς" in low[:-1] or low[-1] == "σ" else 0.0)
    return cost


def _common_han(c: str) -> bool:
    """Among the characters that Chinese or Japanese sets list first, as their most common."""
    try:
        if 0xB0 <= c.encode("gb2312")[0] <= 0xD7:
            return True
    except UnicodeEncodeError:
        pass
    try:
        return 0x88 <= c.encode("shift_jis")[0] <= 0x97
    except UnicodeEncodeError:
        return False


def _run_extra(run: str) -> float:
    """What a run costs beyond its characters one by one: words in other scripts, stretches of accented letters, half-width signs."""
    cost = 0.0
    for m in LATIN_STRETCH.finditer(run):
        if not all(c in DOUBLED for c in m.group()):
            cost += 0.6 * (m.end() - m.start() - (2 if max(m.group()) < "\u0100" else 3))
    if any("\u0370" <= c for c in run):
        for words in (CYRILLIC_WORD, GREEK_WORD):
            cost += sum(_word_cost(m.group()) for m in words.finditer(run))
        cost += 0.5 * len(HALFWIDTH.findall(run))
    return cost


COSTS: dict[str, float] = {}  # known costs, by the three characters


def char_cost(before: str, c: str, after: str) -> float:
    """How implausible a character outside ASCII is between its neighbours (empty at the ends of the text)."""
    key = f"{before or chr(0)}{c}{after or chr(0)}"
    if key not in COSTS:
        if len(COSTS) > 200_000:
            COSTS.clear()
        COSTS[key] = _char_cost(before, c, after)
    return COSTS[key]


def _char_cost(before: str, c: str, after: str) -> float:
    o = ord(c)
    if c == "\ufffd":
        return 5.0
    if 0x80 <= o < 0xA0:
        return 4.0
    if c == "µ":  # a sign among the letters
        return 2.0 if before.isalpha() else 0.0
    if c.isalpha() and c not in "ªº":
        return _letter_cost(before, c, after)
    kind = unicodedata.category(c)
    if kind in ("Co", "Cn", "Cs"):
        return 3.0
    if o >= 0x1F000 or 0x2600 <= o < 0x27C0 or o in (0x200D, 0xFE0F):  # pictures, and what joins them
        return 0.0
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:  # marks of East Asian writing
        return 1.0 if any(x.isascii() and x.isalpha() for x in (before, after)) else 0.0
    left, right = before.isalpha(), after.isalpha()
    strange = any(x and ord(x) > 127 and x not in QUOTES for x in (before, after))
    if c in "ªº":
        return 0.0 if (before.isdigit() or before and before in "nN") and not right else 2.0 if left else 0.4
    if c in QUOTES:
        return 1.0 if left and right and c in "“”„«»‹›" else 0.0
    if c == "\xad":
        return 0.2 if left and right and ord(before) < 128 and ord(after) < 128 else 2.0
    if c == "‚":
        return 2.0 if left or right or strange else 0.4
    if c in "¿¡":
        return 2.0 if left or (strange and not right) else 0.0
    if c in BESIDE:
        if left and (right or ord(before) > 127):
            return 2.0
        if right and c != "°":
            return 2.0
        return 1.0 if left and c not in "™®©²³¹°" else 0.3 if strange else 0.0
    if kind.startswith("M"):
        return 0.2 if left else 1.5
    return 2.5 if left or right else 1.5 if strange else 0.4


def misread_pairs() -> frozenset[str]:
    """What the two UTF-8 bytes of each sign and letter of Latin-1 look like, read one by one in the known encodings."""
    out = set()
    for read in READ_AS:
        for o in range(0xA0, 0x100):
            try:
                out.add(chr(o).encode("utf-8").decode(read))
            except UnicodeDecodeError:
                continue
    return frozenset(out)


PAIRS = misread_pairs()
PAIR_COST, QUOTED_PAIR_COST = 1.0, 0.7  # the latter where the second may be a closing quotation mark


RUNS: dict[tuple[str, str, str], float] = {}  # known costs of runs, by what stands around them


def run_cost(before: str, run: str, after: str) -> float:
    """Cost of a run of characters outside ASCII; each pair that looks like two bytes read one by one adds to it."""
    key = before, run, after
    cost = RUNS.get(key)
    if cost is None:
        if len(RUNS) > 200_000:
            RUNS.clear()
        cost = RUNS[key] = _run_cost(before, run, after)
    return cost


def _run_cost(before: str, run: str, after: str) -> float:
    total = _run_extra(run)
    for i in range(len(run) - 1):
        if run[i : i + 2] in PAIRS:
            total += QUOTED_PAIR_COST if run[i + 1] in QUOTES else PAIR_COST
    for i, c in enumerate(run):
        if ord(c) > 127:
            total += char_cost(run[i - 1] if i else before, c, run[i + 1] if i + 1 < len(run) else after)
    return total


def entity_cost(text: str) -> float:
    """Character entities cost half each where they stand for characters outside ASCII; those of markup and ASCII are no sign of a wrong decoding."""
    return 0.5 * sum(not html.unescape(m.group()).isascii() for m in ENTITY.finditer(text)) if "&" in text else 0.0


def text_cost(text: str) -> float:
    """Sum of the costs of all characters outside ASCII, and of character entities for such."""
    total = entity_cost(text)
    for m in RUN.finditer(text):
        i, j = m.span()
        total += run_cost(text[i - 1 : i], m.group(), text[j : j + 1])
    return total


def suspicious(text: str) -> bool:
    """Some run of the text costs enough for a search."""
    if "&" in text and entity_cost(text):
        return True
    return any(run_cost(text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]) >= SUSPECT for m in RUN.finditer(text))


def _encode(run: str, encoding: str) -> bytes:
    """Bytes of a run; the five bytes cp1252 leaves out pass as control characters, as in common readers."""
    try:
        return run.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(encoding) for c in run)


SINGLE = frozenset(["cp1252", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "koi8_r", "cp866"])
EAST = frozenset(["shift_jis", "gbk"])
OPERATIONS = [
    (r, w) for w in WRITTEN_IN for r in READ_AS
    if r != w and not (w in ("cp1252", "cp1254") and r in ("latin-1", "iso8859_15", "cp1254", "cp1252")) and not (w in EAST and r not in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850"))
]
#: Two-byte encodings whose second byte may look like ASCII: a run takes the letters in that range along.
EAST_RUN = re.compile("(?:[^\x00-\x7f][\x40-\x7e]?)+")
CHANGES: dict[tuple, str] = {}  # known readings of runs


def apply(text: str, operation: tuple[str, str]) -> str:
    """The text with each run re-read where that makes it more plausible; runs that cannot be re-read stay."""
    if operation[0] == "unescape":
        return ENTITY.sub(lambda m: u if not (u := html.unescape(m.group())).isascii() else m.group(), text)

    def change(m: re.Match) -> str:
        i, j = m.span()
        key = operation, text[i - 1 : i], m.group(), text[j : j + 1]
        found = CHANGES.get(key)
        if found is None:
            if len(CHANGES) > 200_000:
                CHANGES.clear()
            found = CHANGES[key] = _reread(*key)
        return found

    return (EAST_RUN if operation[1] in EAST else RUN).sub(change, text)


def _reread(operation: tuple[str, str], before: str, run: str, after: str) -> str:
    read, written = operation
    if written in EAST:
        cost = lambda x: sum(run_cost(x[m.start() - 1 : m.start()] or (before if not m.start() else ""), m.group(), x[m.end() : m.end() + 1] or after) for m in RUN.finditer(x))
        try:
            other = _encode(run, read).decode(written)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return run
        return other if cost(other) < cost(run) else run
    if run_cost(before, run, after) < 0.3:
        return run
    try:
        other = _encode(run, read).decode(written)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return _pieces(operation, before, run, after)
    return other if run_cost(before, other, after) < run_cost(before, run, after) else run


def _pieces(operation: tuple[str, str], before: str, run: str, after: str) -> str:
    """A run of sound and garbled characters, in one sweep: each longest stretch that can be re-read is, if that is more plausible, else its characters one by one.

    In UTF-8 characters are two to four bytes, as many as follow each other; else they are single.
    """
    read, written = operation
    units: list[str] = []  # re-read characters; empty where that cannot be
    sizes: list[int] = []
    i = 0
    while i < len(run):
        n, unit = 1, ""
        try:
            first = _encode(run[i], read)
            if written == "utf-8" and len(first) == 1:
                n = 2 if 0xC2 <= first[0] <= 0xDF else 3 if 0xE0 <= first[0] <= 0xEF else 4 if 0xF0 <= first[0] <= 0xF4 else 1
            unit = _encode(run[i : i + n], read).decode(written)
        except (UnicodeDecodeError, UnicodeEncodeError):
            n = 1
        units.append(unit)
        sizes.append(n)
        i += n
    out, i, k = "", 0, 0
    while k < len(units):
        if not units[k]:
            out, i, k = out + run[i], i + 1, k + 1
            continue
        last = k
        while last < len(units) and units[last]:
            last += 1
        j = i + sum(sizes[k:last])
        left, right = run[i - 1] if i else before, run[j] if j < len(run) else after
        other = "".join(units[k:last])
        if run_cost(left, other, right) < run_cost(left, run[i:j], right):
            out += other
        else:
            for unit, n in zip(units[k:last], sizes[k:last]):
                left, right = run[i - 1] if i else before, run[i + n] if i + n < len(run) else after
                out += unit if run_cost(left, unit, right) < run_cost(left, run[i : i + n], right) else run[i : i + n]
                i += n
        i, k = j, last
    return out


# Letters beyond ASCII that words of these languages are written with.
LETTERS_OF = {
    "en": "éèêëïñçâôöü", "de": "äöüß", "fr": "àâçèéêëîïôùûüœæÿ", "es": "áéíñóúü", "pt": "áâãàçéêíóôõúü", "nl": "éèëïöü", "it": "àèéìîòóù", "sv": "åäöé", "da": "æøåé", "no": "æøåé",
    "tr": "çğıöşüâîû", "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž", "hu": "áéíóöőúüű", "ro": "ăâîșțşţ",
}
LETTERS = re.compile(r"[^\W\d_]+")
WEST, EAST_LATIN = ("en", "de", "fr", "es", "pt", "nl", "it", "sv", "da", "no"), ("pl", "cs", "hu", "ro")


def _confusable(read: str, written: str) -> dict[str, str]:
    """Letters as read, with the letter of the other encoding that has the same byte, where these differ."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            c, w = bytes([byte]).decode(read), bytes([byte]).decode(written)
        except UnicodeDecodeError:
            continue
        if c != w and c.isalpha() and w.isalpha():
            out[c] = w
    return out


class Confusion:
    """Single-byte encodings that put letters of other languages at the same bytes, so that each character is plausible on its own."""

    def __init__(self, read: str, written: str, languages: tuple[str, ...]):
        self.name, self.languages = f"{read}>{written}", languages
        pairs = _confusable(read, written)
        self.meant, self.seen, self.misread = str.maketrans(pairs), re.compile("[" + "".join(pairs) + "]"), frozenset(pairs)

    def restored(self, text: str) -> str:
        """The text with its misread words as they were written.

        The text's language tells by its function words, as they were written. Its words with a
        letter that the language does not have count as misread if the other reading leaves
        only letters that it has; one of them must be in lower case, as the others may be
        names, and they must be most of the words with such letters, as else the letters belong
        to another language.
        """
        if not self.seen.search(text):
            return text
        spoken = language(text.translate(self.meant))
        if spoken not in self.languages:
            return text
        own = LETTERS_OF[spoken]
        alien = lambda w: any(c > "\x7f" and c.lower() not in own for c in w)
        fits = lambda w: alien(w) and self.seen.search(w) and not alien(w.translate(self.meant))
        words = [w for w in LETTERS.findall(text) if alien(w) and (w.islower() or self.seen.search(w))]
        fit = [w for w in words if fits(w)]
        if not any(w.islower() for w in fit) or 2 * len(fit) <= len(words):
            return text
        return LETTERS.sub(lambda m: m.group().translate(self.meant) if fits(m.group()) else m.group(), text)


CONFUSIONS = [Confusion("cp1250", "cp1252", WEST), Confusion("cp1252", "cp1254", ("tr",)), Confusion("cp1252", "cp1250", EAST_LATIN), Confusion("cp1254", "cp1252", WEST)]


def restore(text: str, gain: float = GAIN, max_states: int = MAX_STATES) -> tuple[bool, str, list[str], bool]:
    """As ``search``, with the words whose misread characters are plausible one by one (``Confusion``).

    A text all of whose letters are of its own language is not misread.
    """
    garbled, found, path, whole = search(text, gain, max_states)
    letters = {c for c in set(found) if c > "\x7f" and c.isalpha()}
    if not any(letters & c.misread for c in CONFUSIONS):
        return garbled, found, path, whole
    own = LETTERS_OF.get(language(found), "")
    if all(c.lower() in own for c in letters):
        return garbled, found, path, whole
    for confusion in CONFUSIONS:
        read = confusion.restored(found)
        if read != found:
            return True, read, [*path, confusion.name], whole
    return garbled, found, path, whole


def _all_runs(text: str, found: str, path: tuple) -> tuple[str, tuple]:
    """The reading found, or that of all runs by its steps or the first of them, where no dearer: a letter alone is plausible in any reading.

    Where most characters were changed, half a point a run may be spent on changing the others too.
    """
    best, best_path, steps = found, path, ()
    price = lambda t, p: text_cost(t) + sum(STEPS.get(w or r, STEP) for r, w in p)
    least, before = price(found, path), RUN.findall(text)
    whole = text
    for read, written in path:
        steps = (*steps, (read, written))
        if read == "unescape" or written in EAST:
            whole = apply(whole, (read, written))
            continue

        def change(m: re.Match, read=read, written=written) -> str:
            try:
                return _encode(m.group(), read).decode(written)
            except (UnicodeDecodeError, UnicodeEncodeError):
                return m.group()

        whole = RUN.sub(change, whole)
        if whole != best:
            kept = [a for a, b in zip(before, RUN.findall(found)) if a == b]
            spare = 0.5 * len(kept) if 2 * sum(map(len, kept)) < sum(map(len, before)) else 0.0
            cost = price(whole, steps)
            if cost <= least + spare + 1e-9:
                best, best_path, least = whole, steps, min(cost, least)
    return best, best_path


def search(text: str, gain: float = GAIN, max_states: int = MAX_STATES) -> tuple[bool, str, list[str], bool]:
    """(garbled, best text, operations, whole): best-first search over re-reading operations.

    States are texts, seen ones are known by their hash. Steps cost more than nothing; the state
    with the least sum of the steps' costs and its text's cost is looked at next (those read as
    UTF-8 sooner), first readings a little dearer than the text are opened too, and the search ends when no open state
    can lead to a smaller sum. Garbled: the best text was re-read and is cheaper by ``gain``,
    the text costs ``UNRESTORED`` or more though nothing restores it, or it holds replacement
    or control characters that only a wrong decoding leaves. Entities alone are no wrong
    decoding. whole: nothing was lost and hardly anything implausible is left.
    """
    if not suspicious(text):
        return False, text, [], True
    start = text_cost(text)
    gone = text.count("\ufffd")
    lost = gone > 0 or any("\x80" <= c < "\xa0" and c != "\x85" for c in text)
    if start < gain - 1e-9 and not lost:
        return False, text, [], True
    best, best_text, best_path = start, text, ()
    heap, seen, looked = [(start, 0, 0.0, start, text, ())], {hash(text)}, 0
    while heap and looked < max_states:
        _, _, paid, cost, now, path = heapq.heappop(heap)
        if paid + 5.0 * gone + min(STEPS.values()) >= best:  # replacement characters stay whatever is done
            continue
        operations = OPERATIONS + ([("unescape", "")] if "&" in now and entity_cost(now) else [])
        for op in operations:
            step = paid + STEPS.get(op[1] or op[0], STEP)
            if step + 5.0 * gone >= best:
                continue
            other = apply(now, op)
            looked += 1
            if other == now or hash(other) in seen:
                continue
            seen.add(hash(other))
            c = text_cost(other)
            if c > cost + (UPHILL if not path else 0.0):
                continue
            steps = (*path, op)
            if step + c < best - 1e-9:
                best, best_text, best_path = step + c, other, steps
            heapq.heappush(heap, (step + c * (GUIDE if op[1] == "utf-8" else 1.0), looked, step, c, other, steps))
    best_text, best_path = _all_runs(text, best_text, best_path)
    reread = any(op[0] != "unescape" for op in best_path)
    left = text_cost(best_text)
    garbled = lost or start >= UNRESTORED or (reread and start - left >= gain - 1e-9)
    if not garbled:
        return False, text, [], True
    whole = not gone and looked < max_states and left < min(gain, 0.25 * start)
    return True, best_text, [f"{r}>{w}" for r, w in best_path], whole


def garbled_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, operations, whole) of documents decoded, wholly or partly, with a wrong encoding.

    restored: the most plausible text the search reached; whole: nothing implausible is left in
    it (false where bytes were lost). Texts of ASCII without entities cannot be garbled and are
    left out by a JVM filter; the others are searched whole, in Arrow batches, without a
    shuffle. Null and empty texts are not garbled. Repeated documents count each. An empty
    table gives an empty result. lang and other columns are not used.
    """
    suspects = spread(documents.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").rlike(r"[^\x00-\x7f]|&[#A-Za-z]")), "doc_id")

    def restored(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                garbled, text, path, whole = restore(t)
                if garbled:
                    out.append((i, text, path, whole))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "restored", "operations", "whole"])

    return suspects.mapInArrow(restored, "doc_id bigint, restored string, operations array<string>, whole boolean")
