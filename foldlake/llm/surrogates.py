"""Surrogates for personal data: keyed, of the same type, gender, script and format.

Entities are found by pattern: e-mail addresses, phone numbers, card and account numbers, IPv4
addresses, social security numbers, IBANs, and names. A name is a run of capitalised words (particles
and initials among them) after a title, which may tell the gender, or after a given name that is
listed by gender; words of a name that stand by themselves elsewhere in the text are found too.

Each value is replaced by format-preserving encryption: its characters are classed (digit, vowel or
consonant of a script, case), the value is a number in the product of these classes, and a keyed
Feistel network with cycle walking permutes that range. A listed given name becomes another one of
its gender, script and length by a keyed permutation of these; other words become words that are not
listed, of the same letters' classes, with the last letter kept, which marks gender in many languages.
So equal values get equal surrogates in all documents (coreference), and different ones never meet
(distinctness), without a table of entities; length, casing, grouping and script stay. What must hold
of a type is kept on both sides of the permutation: a number that passes the Luhn check becomes
another that does, and one that fails stays failing. `walk` checks for collisions with the original:
where the permutation leaves a value as it is, a run of such values and its successor change places.
`replaced` checks for collisions in a text: a surrogate that stands in the text as a value or word of
its own, or that another value of the text has, is left for the next one of that value; so a value
keeps its surrogate in all documents but such ones.

The key is the caller's: who has it can undo the surrogates. There is no default.

Defined results: a null text stays null with no entities, an empty one empty; texts without entities
come back as they are; equal rows get equal results; an empty table gives an empty result; a text's
time and memory grow with its length and its entities. Other columns are left alone by `replace`,
whatever their names; n_chars stays right as lengths do.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "name")
#: Surrogates that a value may try in a text before one of them is taken whatever stands there.
TRIES = 50

# Titles by the gender they mark, and those that mark none.
HONORIFICS = {
    "m": ["Mr", "Mr.", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "M.", "Señor", "Sr.", "Don", "Signor", "господин", "г-н", "κύριος", "κ."],
    "f": ["Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mme.", "Mlle", "Mademoiselle", "Señora", "Señorita", "Sra.", "Srta.", "Doña", "Signora", "госпожа", "г-жа", "κυρία", "κα"],
    "": ["Dr", "Dr.", "Doctor", "Prof", "Prof.", "Professor", "Professorin", "Mx", "Mx.", "Rev.", "Docteur", "Doktor", "Dra.", "Profesor", "Profesora"],
}
# Given names by gender.
GIVEN = {
    "m": "Adam Alan Alberto Alexander Alfred Andreas Andrew Anton Antonio Arthur Benjamin Bernd Brian Carlos Charles Christian Christopher Claude Daniel David Diego Dieter Edward Emil Enrique Eric "
    "Fernando Francisco Frank François Fritz George Gerhard Guillaume Hans Heinrich Henri Henry Jacques James Javier Jean Johann John Jonathan Jorge Joseph José Juan Karl Kevin Klaus Lars Louis Luis "
    "Manuel Martin Matthew Michael Michel Miguel Nicolas Oliver Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert Sebastian Stefan Stephen Thomas Walter Werner William Wolfgang "
    "Иван Пётр Павел Сергей Андрей Дмитрий Николай Алексей Михаил Владимир Борис Юрий Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος",
    "f": "Alice Amelia Amélie Ana Andrea Angela Anna Anne Barbara Beatriz Brigitte Camille Carmen Carolina Caroline Catherine Charlotte Christine Claire Claudia Daniela Dolores Dorothy Elena Eleanor "
    "Elisabeth Elizabeth Emily Emma Erika Eva Françoise Gabriela Gisela Greta Hannah Heike Helen Helga Ingrid Isabel Isabelle Jane Jennifer Jessica Joan Johanna Julia Juliette Karin Katharina Laura "
    "Linda Lisa Lucía Madeleine Margaret Maria Marie Marta Martha Mary Michelle Monika Monique Mónica Nancy Nathalie Patricia Petra Pilar Rachel Rebecca Renate Rosa Ruth Sabine Sandra Sara Sarah "
    "Sofía Sophie Susan Susanne Teresa Ursula Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη",
}
# Words in lower case that stand inside a name, and capitalised words that end one.
PARTICLES = "von van der den de del della di da du la le el y al bin ibn zu zur"
ENDS = "The A An And Or In On At He She It They We I Der Die Das Und Er Sie Es Wir Ich Le La Les Un Une Et Il Elle Nous El Los Las Una Y Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag"

_GENDER = {t: g for g, hs in HONORIFICS.items() for h in hs for t in (h, h.upper())}
_GIVEN = {n: g for g, names in GIVEN.items() for n in names.split()}
_STOPS = {t for w in ENDS.split() for t in (w, w.upper())}

_EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.ASCII)
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", re.ASCII)
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])", re.ASCII)
_DIGIT = re.compile("[0-9]")
_WORD = r"(?:[^\W\d_]\.|[^\W\d_]+(?:['’-][^\W\d_]+)*)"
_TITLE = "|".join(re.escape(h) for h in sorted(_GENDER, key=len, reverse=True))
_LISTED = "|".join(sorted((t for n in _GIVEN for t in (n, n.upper())), key=len, reverse=True))
_NAME = re.compile(rf"(?<!\w)(?:((?:(?:{_TITLE})(?!\w)\s{{1,3}})+)|(?=(?:{_LISTED})[ \xa0]))({_WORD}(?:[ \xa0](?:(?:{PARTICLES.replace(' ', '|')})[ \xa0]){{0,3}}{_WORD}){{0,4}})")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTICLES = frozenset(PARTICLES.split())
#: Runs of letters of which a text with a name has one at least.
_TRIGGERS = frozenset(x for t in [*_GENDER, *_GIVEN, *(n.upper() for n in _GIVEN)] for x in _LETTERS.findall(t))

# Letters that change for one another, in lower case: vowels and consonants of a script.
_ALPHABETS = [
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "áàâäãéèêëíìîïóòôöõúùûüý",
    "ñçß",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ",
]
_CLASS = {c: a for a in _ALPHABETS for c in a} | {c.upper(): a.upper() for a in _ALPHABETS for c in a if len(c.upper()) == 1}
_CLASS |= dict.fromkeys("0123456789", "0123456789")
_CLASS["ß"] = "ñçß"


class Cipher:
    """A keyed permutation of 0 to size - 1 for any size and any tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _half(self, tweak: bytes, turn: int, value: int, width: int) -> int:
        data = tweak + bytes([turn]) + value.to_bytes((width + 7) // 8 + 1, "big")
        out = b""
        while len(out) * 8 < width:
            out += hmac.digest(self.key, data + len(out).to_bytes(2, "big"), hashlib.sha256)
        return int.from_bytes(out, "big") & ((1 << width) - 1)

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:  # walk the cycle back into the range
            left, right = value >> half, value & mask
            for turn in range(8):
                left, right = right, left ^ self._half(tweak, turn, right, half)
            value = left << half | right
            if value < size:
                return value

    def walk(self, value: int, size: int, tweak: bytes, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The permutation of the values that fit, changed so that none stays as it is (if two or
        more fit): a run of fixed values moves up by one, its last takes the image of the value after
        the run, and that one takes the first of the run."""

        def image(x: int) -> int:
            y = self.permute(x, size, tweak)
            while not fits(y):
                y = self.permute(y, size, tweak)
            return y

        def step(x: int, by: int) -> int:
            x = (x + by) % size
            while not fits(x):
                x = (x + by) % size
            return x

        out = image(value)
        if out == value:
            after = step(value, 1)
            moved = image(after)
            return after if moved == after else moved
        before = step(value, -1)
        if image(before) != before:
            return out
        while image(low := step(before, -1)) == low:
            before = low
        return before


def _mixed(text: str, free: list[int], cipher: Cipher, tweak: str, fits: Callable[[str], bool] | None = None) -> str:
    """text with the characters at `free` permuted within their classes."""
    classes = [_CLASS[text[i]] for i in free]
    size = value = 0
    for c, i in zip(classes, free, strict=True):
        size, value = (size or 1) * len(c), value * len(c) + c.index(text[i])
    if size < 2:
        return text

    def spelled(v: int) -> str:
        chars = list(text)
        for c, i in zip(reversed(classes), reversed(free), strict=True):
            v, r = divmod(v, len(c))
            chars[i] = c[r]
        return "".join(chars)

    pattern = tweak + "|" + "".join(c[0] for c in classes)
    return spelled(cipher.walk(value, size, pattern.encode(), (lambda v: fits(spelled(v))) if fits else lambda _: True))


def _free(text: str, start: int = 0, end: int | None = None) -> list[int]:
    return [i for i in range(start, len(text) if end is None else end) if text[i] in _CLASS]


def luhn(text: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([c for c in text if c.isdigit()])):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _email(text: str, cipher: Cipher) -> str:
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    keep = 2 if ".".join(labels[-2:]).lower() in ("example.com", "example.org", "example.net") else 1
    host = ".".join(labels[:-keep])
    return _mixed(local, _free(local), cipher, "local") + "@" + ".".join([x for x in (_mixed(host, _free(host), cipher, "host"), *labels[-keep:]) if x])


def _phone(text: str, cipher: Cipher) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    start = code.end() if code else 0
    return _mixed(text, _free(text, start), cipher, f"phone{text[:start]}")


def _card(text: str, cipher: Cipher) -> str:
    valid = luhn(text)
    return _mixed(text, _free(text, 1), cipher, f"card{text[0]}{valid}", lambda t: luhn(t) == valid)


def _ip(text: str, cipher: Cipher) -> str:
    size, value, octets = 1, 0, text.split(".")
    spans = [((0, 10), (10, 100), (100, 256))[len(o) - 1] for o in octets]
    if any(not low <= int(o) < high for o, (low, high) in zip(octets, spans, strict=True)):
        return _mixed(text, _free(text), cipher, "ip with leading zeros", lambda t: all(int(o) < 256 for o in t.split(".")) and any(o != str(int(o)) for o in t.split(".")))
    for o, (low, high) in zip(octets, spans, strict=True):
        size, value = size * (high - low), value * (high - low) + int(o) - low
    value, out = cipher.walk(value, size, b"ip" + bytes(len(o) for o in octets)), []
    for low, high in reversed(spans):
        value, r = divmod(value, high - low)
        out.append(str(low + r))
    return ".".join(reversed(out))


def _ssn(text: str, cipher: Cipher) -> str:
    return _mixed(text, _free(text), cipher, "ssn")


def _iban(text: str, cipher: Cipher) -> str:
    if _iban_rest(text) != 1:
        return _mixed(text, _free(text, 4), cipher, f"iban{text[:4]}", lambda t: _iban_rest(t) != 1)
    out = _mixed(text, _free(text, 4), cipher, f"iban{text[:2]}")
    return f"{out[:2]}{98 - _iban_rest(out[:2] + '00' + out[4:]):02d}{out[4:]}"


def _script(c: str) -> str:
    return "greek" if "Ͱ" <= c <= "Ͽ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"


_PEERS: dict[tuple[str, str, int], list[str]] = {}
for _n, _g in sorted(_GIVEN.items()):
    _PEERS.setdefault((_g, _script(_n[0]), len(_n)), []).append(_n)


def _peers(text: str) -> list[str]:
    """The given names of the same gender, script and length as a listed one."""
    return _PEERS.get((_GIVEN.get(text, "?"), _script(text[0]), len(text)), [])


def _name(text: str, cipher: Cipher) -> str:
    """One word of a name. A listed given name with a peer becomes one; any other word becomes one
    that is not listed, its last letter staying where there are others."""
    if text.isupper() and len(text) > 1 and (plain := text.capitalize()).upper() == text:
        new = _name(plain, cipher)
        return new.upper() if len(new.upper()) == len(text) else new
    if len(peers := _peers(text)) > 1:
        return peers[cipher.walk(peers.index(text), len(peers), f"given{peers[0]}".encode())]
    free = _free(text, 0, len(text) - 1) or _free(text)
    return _mixed(text, free, cipher, f"name{text[-1]}", lambda t: len(_peers(t)) < 2)


_MAKE = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn, "iban": _iban, "name": _name}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender or "") of the entities, without overlaps, in order."""
    found: list[tuple[int, int, str, str]] = []
    patterns = [("email", _EMAIL)] if "@" in text else []
    if _DIGIT.search(text):
        patterns += [("iban", _IBAN), ("ssn", _SSN), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)]
    taken = bytearray(len(text)) if patterns else b""
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, kind, ""))
    names: dict[str, str] = {}
    if not _TRIGGERS.isdisjoint(_LETTERS.findall(text)):
        for gender, words in _named(text):
            for word in words:
                names[word] = names.get(word) or gender
    if names:
        taken = taken or bytearray(len(text))
        for m in _LETTERS.finditer(text):
            if m[0] in names and not any(taken[m.start() : m.end()]):
                found.append((*m.span(), "name", names[m[0]]))
    return sorted(found)


def _named(text: str) -> Iterator[tuple[str, list[str]]]:
    """The gender (or "") and the words of each name that a title or a listed given name begins."""
    at = 0
    while m := _NAME.search(text, at):
        words: list[str] = []
        stop = m.start(2)
        for w in re.finditer(r"[^\s\xa0]+", m[2]):
            word = w[0].rstrip(".")
            full = w[0] if w[0] in _GENDER else word
            if word in _PARTICLES:
                continue
            # what follows the name: another title, a small word, a word at the head of a sentence
            if not word[0].isupper() or full in _GENDER or f"{full}." in _GENDER or word in _STOPS:
                break
            words += [x for x in _LETTERS.findall(word) if x[0].isupper()]
            stop = m.start(2) + w.end()
        titles = m[1].split() if m[1] else []
        gender = next((g for t in titles if (g := _GENDER[t])), "")
        if words and (titles or stop > m.start(2) + len(words[0])):
            listed = words[0].capitalize() if words[0].isupper() else words[0]
            # an initial by itself is no name that could be found again
            yield gender or _GIVEN.get(listed, ""), [w for w in words if len(w) > 1] or words
        at = max(stop, m.start(2)) if stop > m.start() else m.end()


@lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The surrogate of a value; with a turn above zero, another one."""
    return _MAKE[kind](value, Cipher(key if not turn else hmac.digest(key, turn.to_bytes(4, "big"), hashlib.sha256)))


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and the spans (the same in both texts)."""
    if not text or not (spans := find(text)):
        return text, []
    present = {text[a:b] for a, b, _, _ in spans}
    if any(kind == "name" for _, _, kind, _ in spans):
        present.update(_LETTERS.findall(text))
    own: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    out, at = [], 0
    for start, end, kind, _ in spans:
        value = text[start:end]
        if (new := own.get((kind, value))) is None:
            for turn in range(TRIES):
                new = surrogate(kind, value, key, turn)
                if new not in present and new not in used:
                    break
            own[kind, value] = new
            used.add(new)
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), spans


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates by the caller's key), n_entities, a count for each kind, and spans
    (kind:start:end, comma-joined, in code points, end exclusive)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2000, 16 << 20):
            found = [replaced(t, key) for t in batch.column("text").to_pylist()]
            kinds = [[s[2] for s in spans] for _, spans in found]
            columns = [batch.column("doc_id"), pa.array([t for t, _ in found], pa.string()), pa.array([len(k) for k in kinds], pa.int64())]
            columns += [pa.array([k.count(kind) for k in kinds], pa.int64()) for kind in KINDS]
            columns.append(pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans) for _, spans in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text", "n_entities", *(f"n_{k}" for k in KINDS), "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_entities long, {counts}, spans string")


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates by the caller's key in text and all other columns as they are."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([replaced(t, key)[0] for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
