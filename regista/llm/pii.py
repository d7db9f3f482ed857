"""PII surrogates: keyed, type-consistent replacements of detected entities.

Detection finds e-mail addresses, phone, card and account numbers, social security numbers, network addresses, secrets and
personal names. Each entity (kind and canonical form) goes to its image under a keyed permutation of all entities of its
kind and shape: a keyed order of all where the shape has few elements, else a Feistel network ``P`` over the shape's
mixed-radix numbers, used as x -> P^-1(P(x) + 1). Either is one cycle through the whole shape, so that

* different entities have different surrogates and none is its own, however full the shape is, without any state;
* one entity has one surrogate in every document and format (coreference);
* characters keep class, case and script; a country code, an address class (private, public, ...), an issuer's first digit,
  a top-level domain, a secret's prefix and the validity of check digits are part of the shape or kept by walking on along
  the cycle until they hold again, which is still one-to-one.

Given names of the short lists are permuted within gender and script. Other names keep the pattern of vowels and consonants
and their ending (which shows gender: -a, -o, -ова, -ов), and walk past the listed names. A name token has one image
whether it stands as a given or a family name.

``collisions`` checks distinctness over a corpus: it returns the surrogates that stand for more than one entity (none).

Cases: null and empty texts stay as they are, with nothing found; repeated rows and null ids are handled row by row; a
document may mention one entity any number of times; long texts take linear time; an empty table gives an empty result;
further columns pass through, but one called n_found is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import texts, with_columns

# Given names by gender and script, and titles that announce a name.
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Mark George Hans Klaus Pierre Jean Luis Carlos Juan Miguel Jorge".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Laura Julia Maria Sofia Carmen Lucia Claire Sophie Greta Ingrid Heidi Elena".split(),
    "M": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Борис".split(),
    "F": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Людмила Вера".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split()
SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
# Country calling codes of one and two digits (all others have three), and common Chinese family names.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蔡蒋余杜叶程魏苏吕丁任沈姚卢姜崔谭陆范汪石"
#: Letters in daily use, kept apart from rarer ones of their block: Cyrillic, Greek, Greek with accents, Arabic.
COMMON = [range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x3AC, 0x3CF), range(0x621, 0x64B)]
VOWELS = frozenset("aeiouαεηιουωаеёиоуыэюяіїє")

_GENDER = {name: g for g, names in GIVEN.items() for name in names}
_LISTED = {name.lower(): g for name, g in _GENDER.items()}
_CUES = frozenset([*_GENDER, *(n.upper() for n in _GENDER), *TITLES, *(t.upper() for t in TITLES)])
_RUN = re.compile(r"\w+")  # between two \b, as the names' expressions want them
_HAN = "\u4e00-\u9fff"
_LETTERS = rf"[^\W\d_{_HAN}]+"
_NAME = rf"(?:[{_HAN}]{{2,3}}|{_LETTERS}(?:['’-]{_LETTERS})*)"
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]*\w@\w(?:[\w-]*\w)?(?:\.\w(?:[\w-]*\w)?)+")
_SECRET = re.compile(rf"(?i)\b(?:{SECRET_WORDS})\b[\"']?\s*[:=]\s*[\"']?([\w+/=.~-]{{8,}})")
_BARE = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|(?=\w*\d)(?=\w*[A-Fa-f])[0-9A-Fa-f]{32,})\b")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d|\w)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")
_CARD = re.compile(r"(?<![\w])\d(?:[ -]?\d){12,18}(?![\w])")
_TITLED = re.compile(rf"\b(?:{'|'.join(t for x in TITLES for t in (x, x.upper()))})\b\.? +(?:[^\W\d_]\. ?)*({_NAME})(?: +(?:[^\W\d_]\. ?)*({_NAME}))?")
_GIVEN = re.compile(rf"\b({'|'.join(map(re.escape, [*_GENDER, *(n.upper() for n in _GENDER)]))})\b(?: +(?:[^\W\d_]\. ?)*({_NAME}))?")
_SAID = re.compile(rf"(?i:\bmy name is|\bmein Name ist|\bich heiße|\bje m['’]appelle|\bme llamo|\bmi nombre es|\bменя зовут) +({_NAME})(?: +({_NAME}))?")
_SIGNED = re.compile(rf"(?i:\b(?:regards|sincerely|grüße|grüßen|cordialement|saludos)),?[ ]*\n+[ ]*({_NAME})(?: +({_NAME}))?")
_KEYED = re.compile(rf"(?i:\b(?:full[_ ]?name|name|author|contact)[\"']?\s*[:=]\s*[\"']?)({_NAME}) +({_NAME})")
_HONOURED = re.compile(rf"([{HAN_FAMILY}][{_HAN}]{{1,2}}?)(?=先生|女士|小姐)")
_SOUND = re.compile(_LETTERS)
_HAN_RUN = re.compile(rf"[{_HAN}]+")
_PREFIX = re.compile(r"AKIA|gh[pousr]_|sk-|")
_ORDER = {k: i for i, k in enumerate(("email", "secret", "ip", "iban", "ssn", "phone", "card"))}


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def lowered(text: str) -> str:
    """Lower case, character by character, so that no character becomes two."""
    return text.lower() if text.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def phone_of(raw: str) -> str | None:
    """Country code and national number, as "1:7435553824"; None if there are too few or too many digits. A zero in brackets
    belongs to the format."""
    digits = digits_of(raw.replace("(0)", "()"))
    if not 7 <= len(digits) <= 15:
        return None
    if not raw.startswith("+"):
        return "1:" + digits
    code = next((digits[:n] for n in (1, 2) if digits[:n] in CALLING), digits[:3])
    return f"{code}:{digits[len(code) :]}"


def starts_a_name(text: str) -> bool:
    return text[0].isupper() or unicodedata.category(text[0]) == "Lo"


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Personal names: after titles, beside listed given names, after words that introduce or sign a name; then every
    further mention of any of their parts."""
    spans: list[tuple[int, int]] = []
    if not _CUES.isdisjoint(_RUN.findall(text)):
        for m in _TITLED.finditer(text):
            spans += [m.span(g) for g in (1, 2) if m[g]]
        for m in _GIVEN.finditer(text):
            if m[2] and starts_a_name(m[2]) and m[2].capitalize() not in _GENDER:
                spans += [m.span(1), m.span(2)]
    lower = text.lower()
    if any(w in lower for w in ("name", "nombre", "heiße", "appelle", "llamo", "зовут", "author", "contact", "regards", "sincerely", "grüße", "cordialement", "saludos")):
        for m in _SAID.finditer(text):
            spans += [m.span(g) for g in (1, 2) if m[g]]
        for m in _SIGNED.finditer(text):
            if m[2] and starts_a_name(m[2]):
                spans += [m.span(1), m.span(2)]
        for m in _KEYED.finditer(text):
            if starts_a_name(m[1]) and starts_a_name(m[2]):
                spans += [m.span(1), m.span(2)]
    if "先生" in text or "女士" in text or "小姐" in text:
        spans += [m.span(1) for m in _HONOURED.finditer(text)]
    spans = [(a, b) for a, b in spans if starts_a_name(text[a:b]) and text[a:b].capitalize() not in TITLES]
    if not spans:
        return []
    known, han = set(), set()
    for a, b in spans:
        if _HAN_RUN.fullmatch(text, a, b):
            han.add(text[a:b])
        else:
            known.update(lowered(m[0]) for m in _SOUND.finditer(text, a, b) if m.end() - m.start() > 1)
    found = []
    for m in _SOUND.finditer(text):
        canon = lowered(m[0])
        if canon in known and starts_a_name(m[0]):
            found.append((*m.span(), f"given_{_LISTED[canon]}" if canon in _LISTED else "name", canon))
    for m in _HAN_RUN.finditer(text) if han else ():
        at = m.start()
        while at < m.end():
            size = next((n for n in (3, 2) if text[at : at + n] in han), 0)
            if size:
                found.append((at, at + size, "name", text[at : at + size]))
            at += size or 1
    return found


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", lowered(m[0])) for m in _EMAIL.finditer(text)]
    lower = text.lower()
    if any(w in lower for w in ("token", "secret", "passw", "key")):
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m[1]) or not m[1].isalpha():
                found.append((*m.span(1), "secret", m[1]))
    if re.search(r"\d", text):
        found += [(*m.span(), "secret", m[0]) for m in _BARE.finditer(text)]
        found += [(*m.span(), "ip", m[0]) for m in _IP.finditer(text)]
        found += [(*m.span(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text)]
        found += [(*m.span(), "ssn", digits_of(m[0])) for m in _SSN.finditer(text)]
        found += [(*m.span(), "card", digits_of(m[0])) for m in _CARD.finditer(text)]
        found += [(*m.span(), "phone", canon) for m in _PHONE.finditer(text) if (canon := phone_of(m[0]))]
    found += names(text)
    found = [(a, b, kind, canon.lower() if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon) else canon) for a, b, kind, canon in found]
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, without overlaps
    for x in sorted(found, key=lambda x: (_ORDER.get(x[2], 9), x[0], -x[1])):
        at = bisect(taken, x[:2])
        if (at == 0 or taken[at - 1][1] <= x[0]) and (at == len(taken) or x[1] <= taken[at][0]):
            taken.insert(at, x[:2])
            out.append(x)
    return sorted(out)


@lru_cache(100_000)
def kin(c: str, sound: bool = False) -> str:
    """The characters that may stand for ``c``, itself among them: of its script, case and kind in its block of Unicode;
    with ``sound``, vowels for vowels and the others for the others. Characters other than letters and digits stay."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return c

    def kind(x: str) -> tuple:
        other = x.swapcase()
        vowel = sound and unicodedata.normalize("NFD", x.lower())[0] in VOWELS
        daily = next((i for i, r in enumerate(COMMON) if ord(x.lower()[0]) in r), -1)
        return unicodedata.category(x), unicodedata.name(x, "").split(" ")[0], x.isascii(), daily, len(other) == 1 and other.swapcase() == x, vowel

    block = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(block, block + 256)) if x.isalpha() and kind(x) == kind(c))


#: Shapes of up to so many elements are put in a keyed order as a whole.
SMALL = 4096


@lru_cache(512)
def following(stem: bytes, n: int) -> np.ndarray:
    """The number after each of ``n`` in a keyed order of them that closes to a cycle."""
    order = np.frombuffer(hashlib.shake_256(stem).digest(8 * n), "<u8").argsort(kind="stable")
    after = np.empty(n, np.int64)
    after[order] = np.roll(order, -1)
    return after


def cycled(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """The number after the given one (as mixed-radix digits) in the keyed cycle through all numbers of these radices: a keyed
    order of all of them where they are few, a Feistel network over two halves of the free digits where they are many."""
    stem = key + tweak.encode() + repr(radices).encode()
    size = prod(radices)
    if size <= SMALL:
        value = 0
        for d, r in zip(digits, radices, strict=True):
            value = value * r + d
        value, out = int(following(stem, size)[value]), []
        for r in reversed(radices):
            value, d = divmod(value, r)
            out.append(d)
        return out[::-1]
    free = [i for i, r in enumerate(radices) if r > 1]
    half = free[len(free) // 2]  # two free digits at least: one alone is a small shape
    sizes, values = [1, 1], [0, 0]
    for i, (d, r) in enumerate(zip(digits, radices, strict=True)):
        side = i >= half
        sizes[side], values[side] = sizes[side] * r, values[side] * r + d

    def shift(step: int) -> int:
        side = step % 2
        n = sizes[side].bit_length() // 8 + 9
        return int.from_bytes(hashlib.shake_256(b"%b|%d|%d" % (stem, step, values[1 - side])).digest(n), "big")

    for step in range(8):
        values[step % 2] = (values[step % 2] + shift(step)) % sizes[step % 2]
    values[0], values[1] = divmod((values[0] * sizes[1] + values[1] + 1) % (sizes[0] * sizes[1]), sizes[1])
    for step in reversed(range(8)):
        values[step % 2] = (values[step % 2] - shift(step)) % sizes[step % 2]
    out = []
    for side, part in ((1, radices[half:]), (0, radices[:half])):
        for r in reversed(part):
            values[side], d = divmod(values[side], r)
            out.append(d)
    return out[::-1]


#: Places permuted together; longer forms go part by part, each keyed by what stands before it.
PLACES = 48


def permuted(key: bytes, tweak: str, text: str, choices: list[str]) -> str:
    """The next text after ``text`` in its shape, ``choices`` being what may stand at each place."""
    free = [i for i, c in enumerate(choices) if len(c) > 1]
    out = list(text)
    for lo in range(0, len(free), PLACES):
        part = free[lo : lo + PLACES]
        before = hashlib.sha256("".join(out[: part[0]]).encode()).hexdigest() if lo else ""
        for i, d in zip(part, cycled(key, f"{tweak}|{lo}|{before}", [choices[i].index(text[i]) for i in part], [len(choices[i]) for i in part]), strict=True):
            out[i] = choices[i][d]
    return "".join(out)


def like(key: bytes, tweak: str, text: str, choices: list[str] | None = None, same: Callable[[str], object] = lambda x: None) -> str:
    """The next text of the same shape for which ``same`` gives the same."""
    choices = choices or [kin(c) for c in text]
    shape, want, out = tweak + "|" + "|".join(choices), same(text), text
    shape = tweak + hashlib.sha256(shape.encode()).hexdigest()
    while True:
        out = permuted(key, shape, out, choices)
        if same(out) == want:
            return out


def address_class(octets: list[int]) -> str:
    a, b = octets[:2]
    if a in (10, 127):
        return str(a)
    if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32:
        return f"{a}.{b}"
    return "public" if 0 < a < 224 else "multicast" if 224 <= a < 240 else "reserved"


def address(key: bytes, canon: str) -> str:
    """Octets keep their number of digits, the address its class."""
    octets = [int(o) for o in canon.split(".")]
    want = address_class(octets)
    fixed = 0 if want[0].isalpha() else want.count(".") + 1
    low = [10 ** (len(o) - 1) if len(o) > 1 else 0 for o in canon.split(".")]
    size = [1 if i < fixed else (10, 90, 156)[len(o) - 1] for i, o in enumerate(canon.split("."))]
    low = [octets[i] if i < fixed else x for i, x in enumerate(low)]
    now = octets
    while True:
        now = [x + d for x, d in zip(low, cycled(key, f"ip|{fixed}|{low}", [o - x for o, x in zip(now, low, strict=True)], size), strict=True)]
        if address_class(now) == want:
            return ".".join(map(str, now))


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def checksum(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


@lru_cache(200_000)
def surrogate(key: bytes, kind: str, canon: str) -> str:
    """The canonical form of an entity's replacement."""
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] == "example" else 1
        host, top = ".".join(labels[:-keep]), ".".join(labels[-keep:])
        # a host is never moved to one whose last label is kept as well
        moved = like(key, "host", host, same=lambda x: x.rpartition(".")[2] == "example") + "." if host else ""
        return like(key, "local", local) + "@" + moved + top
    if kind == "secret":
        hexadecimal = re.compile(r"[0-9a-f]+").fullmatch
        choices = ["abcdef" if c.isalpha() and hexadecimal(canon) else kin(c) for c in canon]
        prefix = _PREFIX.match(canon)[0]
        choices[: len(prefix)] = prefix
        return like(key, "secret", canon, choices, lambda x: (bool(hexadecimal(x)), _PREFIX.match(x)[0]))
    if kind == "ip":
        return address(key, canon)
    if kind == "iban":
        body = like(key, "iban" + canon[:2], canon[4:])
        check = int(canon[2:4]) - checksum(canon[:2], canon[4:]) + checksum(canon[:2], body)
        return f"{canon[:2]}{check % 100:02d}{body}"
    if kind == "ssn":
        return like(key, "ssn", canon, same=valid_ssn)
    if kind == "card":
        body = canon[0] + like(key, "card" + canon[0], canon[1:-1])
        check = int(canon[-1]) + luhn(canon[:-1] + "0") - luhn(body + "0")
        return body + str(check % 10)
    if kind == "phone":
        code, _, number = canon.partition(":")
        choices = [kin(c) for c in number]
        leading = (0, 3) if code == "1" and len(number) == 10 else (0,)
        for i in leading:  # a first digit stays one that may stand there
            low = "01" if code == "1" else "0"
            choices[i] = low if number[i] in low else "".join(c for c in "0123456789" if c not in low)
        if code == "1" and len(number) == 10 and number[3:6] == "555":
            choices[3:6] = "555"
        same = (lambda x: x[3:6] == "555") if code == "1" and len(number) == 10 else lambda x: None
        return f"{code}:{like(key, 'phone' + code, number, choices, same)}"
    if kind == "name":
        end = 2 if "CYRILLIC" in unicodedata.name(canon[-1], "") else 1 if unicodedata.category(canon[-1]) == "Ll" else 0
        end = min(end, len(canon) - 1)
        choices = [c if i >= len(canon) - end else kin(c, True) for i, c in enumerate(canon)]
        return like(key, "name", canon, choices, lambda x: x in _LISTED)
    order = sorted((n.lower() for n in GIVEN[kind[-1]]), key=lambda n: hashlib.sha256(key + n.encode()).digest())
    return order[(order.index(canon) + 1) % len(order)]


def shaped(raw: str, kind: str, canon: str, new: str) -> str:
    """``new`` in the format and case in which the text wrote the entity."""
    if kind in ("ssn", "card", "phone"):
        number = iter(new.replace(":", "") if raw.startswith("+") else new.rpartition(":")[2])
        return "".join(x if x == "(0)" or not x.isdigit() else next(number) for x in re.findall(r"\(0\)|.", raw, re.DOTALL))
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in raw)
    if kind.startswith("given"):
        return new.upper() if raw.isupper() else new[0].upper() + new[1:]
    if raw == canon:
        return new
    return "".join(u if r.isupper() and len(u := x.upper()) == 1 else x for r, x in zip(raw, new, strict=True))


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and the entities found."""
    found = detect(text)
    out, at = [], 0
    for a, b, kind, canon in found:
        out += [text[at:a], shaped(text[a:b], kind, canon, surrogate(key, kind, canon))]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_found, the number of mentions replaced."""
    names = [c for c in docs.columns if c != "n_found"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "n_found") + ", n_found long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = [replace(t, key) if t else (t, []) for t in given]
            out = with_columns(batch, text=pa.array([g[0] for g in got], pa.string()), n_found=pa.array([len(g[1]) for g in got], pa.int64()))
            yield out.select([*names, "n_found"])

    return docs.mapInArrow(run, schema)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, canon and surrogate of the entities of all texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(*x, surrogate(key, *x)) for t in texts(batch) for x in sorted({f[2:] for f in detect(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(3)], names=["kind", "canon", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, canon string, surrogate string").distinct()


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """Surrogates that stand for several entities of a kind, and entities that are their own surrogate: none, whatever the
    corpus; a check of the method over real data."""
    found = entities(docs, key).groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities"), F.max(F.col("canon") == F.col("surrogate")).alias("own"))
    return found.where("n_entities > 1 OR own")
