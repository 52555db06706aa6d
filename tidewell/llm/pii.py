"""Surrogates for personal data: each detected entity is replaced by another of its kind.

A surrogate is a keyed permutation of the entity's canonical form, so equal entities get equal
surrogates in every document (coreference, whatever their format or case) and different
ones of a kind different surrogates, with no table of what was seen. Only what varies is
permuted: separators, letter case, country codes and top-level domains stay, a private address
stays private, addresses of one domain keep one domain, check digits are made anew, names keep
gender and script. Long forms are permuted in chained blocks, forwards and backwards, so an
entity of any length takes linear time.

A phone number is known by its national number: the country's code and a leading 0 are format, so
"+49 30 1234567" and "030 1234567" get one surrogate, and so do "+1 (212) 555-0187" and
"212-555-0187". Numbers of two countries that share the national one stay distinct by their codes.

Names are found by a title ("Mr. Adam Keller") or by what else tells a person: a closing or a greeting,
a relation ("my colleague Susan Miller"), an introduction, a form's field, or an address behind
it ("Susan Miller <s.miller@x.org>"). What is found without a title has two capitalised words or
more, and none of them occurs in lower case in that document ("Dear The Team" is no name where "the"
occurs). Given names and surnames are replaced on their own, at all their mentions in that document
that don't begin in lower case ("Keller left"), so no mention stays that would tell who is
meant. Initials stay. A name without a gender in its document ("Dr.") takes the one that most
documents of the corpus give that name, so that "Dr. Adam" and "Mr. Adam" are one; if none or as many
give the other, it gets a neutral name.

Permutations can be undone by who has the key, so it comes from the caller or the configuration
(see session_key); tasks get it as a broadcast, and no plan shows it.

What a permutation can't promise is checked over the whole corpus: that a surrogate is no
entity that really occurs, and that no two entities share one. Those that fail get the next variant
until none does; a round computes and compares these only, and the table of all is read, not rewritten.
Each WIDEN variants the domain grows: names, addresses and numbers get longer, private
addresses come from a wider private range, and zero groups take part. If even so ROUNDS variants
don't help, the job fails; it never lets two entities share a surrogate. The exceptions are few; up to
``BROADCAST`` of them go to the tasks as a map, more reach their documents by a join on the
text's hash, where texts that are many rows' are broadcast.

Defined results: a null text stays null, an empty one empty; texts without entities are
unchanged; repeated rows are treated alike; an empty table gives an empty result; other columns
are left alone. Whole texts are searched.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import os
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, discard, materialize, wrapped

BROADCAST = 50_000
#: Variants after which a domain grows, and after which the job fails.
WIDEN, ROUNDS = 12, 96
#: Symbols of a form that are permuted as one number.
CHUNK = 64
#: Where a session's key comes from (Spark hides settings that are called secret).
SETTING, VARIABLE = "spark.tidewell.pii.secret", "TIDEWELL_PII_SECRET"

# Titles by gender (n: they tell none), and names by script and gender.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "г-жа", "κυρία", "κα"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irma", "Julia", "Karla", "Lena"],
    ("latin", "n"): ["Alex", "Charlie", "Jean", "Kim", "Luca", "Nico", "Noa", "Quinn", "Robin", "Sam", "Toni", "Yael"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Илья", "Кирилл", "Лев", "Максим", "Олег", "Павел"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Лариса", "Мария", "Ольга", "Полина"],
    ("cyrillic", "n"): ["Валя", "Женя", "Саша", "Слава"],
    ("greek", "m"): ["Αντώνης", "Γιώργος", "Ηλίας", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Στέφανος"],
    ("greek", "f"): ["Άννα", "Ειρήνη", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία", "Χρύσα"],
    ("greek", "n"): ["Άρτεμις", "Μίκα", "Φώτη", "Χαρά"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fal", "gor", "hel", "kan", "lin", "mor", "nes", "pol", "ran", "sel", "tor", "vin", "wal", "zim"],
    "cyrillic": ["ба", "вал", "гор", "дан", "зел", "кор", "лин", "мор", "нов", "пол", "ран", "сав", "тор", "фил", "чер", "шум"],
    "greek": ["βα", "γαλ", "δαν", "ζαρ", "καλ", "λιν", "μαρ", "νικ", "παλ", "ραν", "σαβ", "ταρ", "φιλ", "χαρ"],
}
SURNAME_ENDS = {
    "latin": {"m": "er", "f": "er", "n": "er"},
    "cyrillic": {"m": "ов", "f": "ова", "n": "енко"},
    "greek": {"m": "ίδης", "f": "ίδου", "n": "άκη"},
}
# What stands before a person's name (the gender that a relation tells, n: none),
# and words that begin a greeting's other forms.
RELATIONS = {
    "m": ["brother", "father", "husband", "son", "uncle", "nephew", "boyfriend", "Bruder", "Vater", "Mann", "frère", "père", "mari", "hermano", "padre", "esposo"],
    "f": ["sister", "mother", "wife", "daughter", "aunt", "niece", "girlfriend", "Schwester", "Mutter", "Frau", "sœur", "mère", "hermana", "madre", "esposa"],
    "n": ["colleague", "friend", "cousin", "boss", "manager", "assistant", "neighbour", "neighbor", "doctor", "lawyer", "teacher", "partner", "Kollege", "Kollegin", "Freund", "Freundin", "collègue", "ami", "amie", "colega", "amigo", "amiga"],
}
POSSESSIVES = ["my", "our", "his", "her", "your", "their", "mein", "meine", "unser", "unsere", "mon", "ma", "notre", "mi", "nuestro", "nuestra"]
CLOSINGS = ["signed", "signed by", "sincerely", "sincerely yours", "yours sincerely", "yours truly", "yours faithfully", "regards", "best regards", "kind regards", "warm regards", "mit freundlichen Grüßen", "viele Grüße", "cordialement", "atentamente", "un saludo"]
GREETINGS = ["dear", "lieber", "liebe", "cher", "chère", "estimado", "estimada", "querido", "querida"]
INTRODUCTIONS = ["my name is", "his name is", "her name is", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es"]
FIELDS = ["full name", "patient", "employee", "cardholder", "account holder", "attn"]
NO_NAMES = {"all", "team", "customer", "customers", "support", "colleagues", "friends", "reader", "readers", "manager", "committee", "sir", "madam"}
# Country calling codes of one and two digits (the others have three), and
# address ranges that are not public.
CALLING = {*"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4"]

_RANGES = [(int(n.network_address), 32 - n.prefixlen) for n in map(ipaddress.ip_network, PRIVATE)]
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_AT = re.compile(r"(?<![\w.+%-])\w[\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_NUMBERS = re.compile(
    r"(?P<phone>(?<![\w+])(?:\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}[ /.-]\d{5,8}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|(?<!\d )[2-9]\d\d [2-9]\d\d \d{4}(?! ?\d)|(?<!\d )0[1-9]\d{0,3}[ /]\d{5,8}(?! ?\d))(?![\w]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9]))"
    r"|(?P<token>(?<![\w-])(?:AKIA[0-9A-Z]{16}|AIza[\w-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|3[47]\d\d(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?![\w]))"
)
_KINDS = ("phone", "secret", "token", "iban", "ip6", "ip", "ssn", "card")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = r"[^\W\d_]+(?:-[^\W\d_]+)*"
_PART = rf"(?:[^\W\d_]\.(?!\w)|{_WORD})"
_NAME = re.compile(rf"(?<!\w)(?P<title>(?:(?:{_TITLE})\.? )+)(?P<name>{_PART}(?: {_PART}){{0,3}})")
_ANY = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_RELATION = {w.casefold(): g for g, ws in RELATIONS.items() for w in ws}
_CUE = re.compile(
    rf"(?<!\w)(?:(?:{_ANY(CLOSINGS)})[,:]?\s{{1,4}}|(?:{_ANY(GREETINGS)}) |(?:{_ANY(INTRODUCTIONS)}) |(?:{_ANY(FIELDS)}): ?"
    rf"|(?:{_ANY(POSSESSIVES)}) (?P<relation>{_ANY(w for ws in RELATIONS.values() for w in ws)}),? )(?=[^\W\d_])",
    re.IGNORECASE,
)
#: What every cue begins with, in lower case; one pass over a text tells where it may have some.
_STARTS = ahocorasick.Automaton()
for _w in [*CLOSINGS, *INTRODUCTIONS, *FIELDS, *(f"{g} " for g in GREETINGS), *(f"{p} {r}" for p in POSSESSIVES for rs in RELATIONS.values() for r in rs)]:
    _STARTS.add_word(_w.lower(), len(_w))
_STARTS.make_automaton()
#: Letters that re takes for an i or an s, whatever the case, but whose lower case is another or two letters.
_ODD = "ıſİ"
_CAPITAL = rf"(?:[^\W\d_]\.(?!\w)|{_WORD})"
_CAPITALS = re.compile(rf"{_CAPITAL}(?: {_CAPITAL}){{1,3}}")
#: A name before an address in angle brackets; longer ones than the window are none.
_BEFORE, _WINDOW = re.compile(rf"(?<!\w)(?:{_CAPITAL} ){{1,3}}{_CAPITAL}\"? ?<$"), 96
_AMERICAN = re.compile(r"[2-9]\d\d[2-9]\d{6}")
_ISSUER = re.compile(r"4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]).{14}|3[47].{13}|3[068].{12}|35.{14}|6(?:011|5..|4[4-9].).{12}")
#: Patterns that begin with a set of characters, which re skips to, find where the ones above may match: those
#: begin with a look behind and are tried at every character otherwise.
_RUN = re.compile(r"[\d+(:](?:(?<=[0-9])[0-9A-Za-z]+)?")
_TOKENS = ("AKIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
_TOKEN = re.compile("|".join(_TOKENS))
_ALNUM, _HEX = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), frozenset("0123456789ABCDEFabcdef")
_ENDS = {c: "|".join(re.escape(t[1:]) for ts in TITLES.values() for t in ts if t[0] == c) for ts in TITLES.values() for c in {t[0] for t in ts}}
_TITLED = re.compile("|".join(rf"{c}(?<!\w{c})(?=(?:{ends})\.? )" for c, ends in _ENDS.items()))
_PLAIN = re.compile("[0-9@]")


def session_key(spark: SparkSession, _drawn: list[str] = []) -> bytes:  # noqa: B006
    """The key of the setting or the environment; without either, one drawn at random for this
    driver, so that surrogates agree within the session and nobody can undo them later."""
    found = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    if not found:
        if not _drawn:
            _drawn.append(secrets.token_hex(32))
        found = _drawn[0]
    return found.encode()


def fixed_length(key: bytes) -> bytes:
    if not key:
        raise ValueError("surrogates need a key")
    return hashlib.blake2b(key, digest_size=32).digest()


def luhn(digits: str) -> int:
    """The check digit of these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 if x > 9 else x
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def noise(message: str, key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(message.encode(), key=key, digest_size=64).digest(), "big")


def permute(value: int, size: int, tweak: str, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1, which must be far below 2 ** 512: a Feistel network
    over pairs below a square, walked until it falls into the range."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for turn in range(6):
            a, b = b, (a + noise(f"{tweak}/{size}/{turn}/{b}", key)) % side
        value = a * side + b
        if value < size:
            return value


def permute_digits(digits: list[int], bases: list[int], tweak: str, key: bytes, chunk: int = CHUNK) -> list[int]:
    """A keyed permutation of lists of digits, each below its base, of any length. Blocks of
    them are permuted as numbers; each depends on the block that was done before it, and with
    a second turn from the end every block depends on all."""
    out = list(digits)
    blocks = range(0, len(out), chunk)
    for turn, order in enumerate([blocks, reversed(blocks)] if len(blocks) > 1 else [blocks]):
        before = ""
        for at in order:
            value, size = 0, 1
            for x, base in zip(out[at : at + chunk], bases[at : at + chunk]):
                value, size = value * base + x, size * base
            value = permute(value, size, f"{tweak}/{turn}/{at}/{before}", key)
            before = str(value)
            for i in reversed(range(at, min(at + chunk, len(out)))):
                value, out[i] = divmod(value, bases[i])
    return out


def _radix(text: str, tweak: str, key: bytes, kept: int = 0) -> str:
    """Permutes letters (small and large ones among themselves) and digits of a form at their
    places, but for the first so many characters."""
    zero = [0 if i < kept or not c.isascii() or not c.isalnum() else 48 if c.isdigit() else 97 if c >= "a" else 65 for i, c in enumerate(text)]
    spots = [i for i, z in enumerate(zero) if z]
    shape = "".join("d" if z == 48 else "l" if z == 97 else "L" if z else c for c, z in zip(text, zero))
    if len(shape) > 64:
        shape = hashlib.blake2b(shape.encode(), digest_size=16).hexdigest()
    new = permute_digits([ord(text[i]) - zero[i] for i in spots], [10 if zero[i] == 48 else 26 for i in spots], f"{tweak}/{shape}", key)
    out = list(text)
    for i, x in zip(spots, new):
        out[i] = chr(x + zero[i])
    for i, c in enumerate(text):  # other scripts' letters: drawn, and checked like names
        if i >= kept and not c.isascii() and c.isalpha() and (of := letters(script(c))):
            out[i] = of[noise(f"{tweak}/{i}/{text}", key) % len(of)]
    return "".join(out)


@lru_cache(4096)
def _script(c: str) -> str:
    return unicodedata.name(c, "latin").split()[0].lower()


def script(text: str) -> str:
    """The script of the first letter, as Unicode calls it."""
    return next((_script(c) for c in text if c.isalpha()), "latin")


@lru_cache(64)
def letters(form: str) -> str:
    """The small or caseless letters of a script."""
    start = form.upper() + " "
    plain = (c for c in map(chr, range(0x80 if form != "latin" else 97, 0xFFFF)) if c.isalpha() and not c.isupper())
    return "".join(c for c in plain if unicodedata.name(c, "").startswith(start) and unicodedata.normalize("NFKC", c) == c)


def _name(kind: str, canonical: str, variant: int, key: bytes) -> str:
    what, form, gender = kind.split(":")
    drawn = noise(f"{kind}/{variant}/{canonical}", key)
    if form not in SYLLABLES:  # a name of its own script's letters
        of = letters(form) or letters("latin")
        return "".join(of[(drawn >> 16 * i) % len(of)] for i in range(min(max(len(canonical), 2), 8) + min(variant, 20)))
    parts = SYLLABLES[form]
    pick = lambda i: parts[(drawn >> 8 * (i + 2)) % len(parts)]
    if what == "given":
        names = GIVEN[form, gender]
        # beyond the plain names, longer ones
        return "".join(pick(i) for i in range(min(variant, 50))) + names[drawn % len(names)].lower()
    return "".join(pick(i) for i in range(3 + min(variant, 50))) + SURNAME_ENDS[form][gender]


def _address(value: int, tweak: str, key: bytes, wider: int) -> int:
    """Another of the same private range, or another public one. wider: from all of 10.0.0.0/8,
    then from the range that nobody has, then from the public ones."""
    held = next((r for r in _RANGES if value >> r[1] == r[0] >> r[1]), None)
    if held and wider < 3:
        start, bits = max([held, _RANGES[1], _RANGES[-1]][: wider + 1], key=lambda r: r[1])
        return start + permute(value - held[0], 1 << bits, f"{tweak}/{held[0]}", key)
    while True:
        value = permute(value, 1 << 32, tweak, key)
        if not any(value >> bits == start >> bits for start, bits in _RANGES):
            return value


def _national(number: str, tweak: str, key: bytes) -> str:
    """Another national number of as many digits: one that North America's plan allows stays such
    a one, no other becomes one, and none begins with a 0 that didn't."""
    american = bool(_AMERICAN.fullmatch(number))
    least = [2 if american and i in (0, 3) else int(i == 0 and number[0] != "0") for i in range(len(number))]
    bases = [1 if i == 0 and number[0] == "0" else 10 - low for i, low in enumerate(least)]
    while True:
        new = permute_digits([int(c) - low for c, low in zip(number, least)], bases, f"{tweak}/{len(number)}/{american}/{number[0] == '0'}", key)
        number = "".join(str(d + low) for d, low in zip(new, least))
        if american == bool(_AMERICAN.fullmatch(number)):
            return number


@lru_cache(1 << 14)
def surrogate(kind: str, canonical: str, variant: int, key: bytes) -> str:
    """The canonical form that stands for this one."""
    tweak, wider = f"{kind}/{variant}", variant // WIDEN
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        local += "a" * wider
        head, _, top = domain.rpartition(".")
        return f"{_radix(local, tweak, key)}@{_radix(head, f'domain/{variant}', key)}.{top}"
    if kind == "ip":
        value = _address(int(ipaddress.IPv4Address(canonical)), tweak, key, wider)
        return str(ipaddress.IPv4Address(value))
    if kind == "ip6":  # groups that are zero stay so, and the first stays for its scope
        groups = [int(g, 16) for g in canonical.split(":")]
        if wider:
            new = permute_digits(groups[1:], [65536] * 7, f"{tweak}/{groups[0]}", key)
            return ":".join(f"{g:04x}" for g in groups[:1] + new)
        some = [i for i, g in enumerate(groups) if g and i]
        new = permute_digits([groups[i] - 1 for i in some], [65535] * len(some), f"{tweak}/{groups[0]}/{some}", key)
        for i, g in zip(some, new):
            groups[i] = g + 1
        return ":".join(f"{g:04x}" for g in groups)
    if kind == "secret":
        digits = permute_digits([int(c, 16) for c in canonical], [16] * len(canonical), f"{tweak}/{len(canonical)}", key)
        return "".join(f"{d:x}" for d in digits)
    if kind == "token":
        start = re.match(r"AKIA|AIza|gh._|sk-|xox.-|eyJ", canonical).end()
        return _radix(canonical, tweak, key, start)
    if kind == "phone":
        return _national(canonical + "0" * wider, tweak, key)
    if kind == "ssn":
        a, b, c = int(canonical[:3]) - 1, int(canonical[3:5]) - 1, int(canonical[5:]) - 1
        a -= a >= 666  # 001 to 899 without 666
        x = permute((a * 99 + b) * 9999 + c, 898 * 99 * 9999, tweak, key)
        x, c = divmod(x, 9999)
        a, b = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}{b + 1:02d}{c + 1:04d}"
    if kind == "card":
        kept = 1 if canonical[0] == "4" else 4 if canonical[0] == "6" else 2
        body = _radix(canonical[:-1], tweak, key, kept)
        return body + str(luhn(body))
    if kind == "iban":
        body = _radix(canonical[4:], tweak, key)
        return canonical[:2] + iban_check(canonical[:2], body) + body
    return _name(kind, canonical, variant, key)


def _phone(value: str) -> tuple[str, int]:
    """The national number, and how many digits stand before it: a country's code, a 0, or both."""
    digits = re.sub(r"\D", "", value)
    kept = next((n for n in (1, 2) if digits[:n] in CALLING), 3) if value[0] == "+" else 0
    kept += digits[kept : kept + 1] == "0"
    return digits[kept:], kept


def _spots(text: str) -> list[int]:
    """All places where _NUMBERS may match: a sign, two colons, the beginning of letters and digits of which one is a
    digit or which a colon follows, and that of a token. No other begins one, as each kind looks behind itself."""
    spots = {m.start() for m in _TOKEN.finditer(text)} if any(t in text for t in _TOKENS) else set()
    for m in _RUN.finditer(text):
        at = m.start()
        if text[at] in "+(:":
            spots.add(at)
        if text[at] not in "+(":
            of, least = (_HEX, max(at - 4, 0)) if text[at] == ":" else (_ALNUM, 0)
            while at > least and text[at - 1] in of:
                at -= 1
            spots.add(at)
    return sorted(spots)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    at = 0
    for spot in _spots(text):
        if spot < at or not (m := _NUMBERS.match(text, spot)):
            continue
        kind = next(k for k in _KINDS if m.group(k))
        value, at = m.group(), m.end()
        if kind == "phone":
            while len(re.sub(r"\D", "", value)) > 15:  # numbers may follow each other
                value = value[: max(value.rfind(c) for c in " .-")]
            at = m.start() + len(value)
            number, kept = _phone(value)
            if number and kept + len(number) >= 7:
                yield m.start(), at, kind, number
        elif kind == "card":
            digits = re.sub(r"\D", "", value)
            if _ISSUER.fullmatch(digits) and luhn(digits[:-1]) == int(digits[-1]):
                yield m.start(), at, kind, digits
        elif kind == "ip":
            if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split(".")):
                yield m.start(), at, kind, value
        elif kind == "ip6":
            try:
                plain = ipaddress.IPv6Address(value).exploded
            except ValueError:
                continue
            if sum(g != "0000" for g in plain.split(":")[1:]) and len(re.findall("[0-9A-Fa-f]+", value)) > 2:
                yield m.start(), at, kind, plain
        elif kind == "secret":
            if re.search("[0-9]", value) and re.search("[A-Fa-f]", value):
                yield m.start(), at, kind, value.lower()
        elif kind == "iban":
            plain = value.replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
                yield m.start(), at, kind, plain
        elif kind == "token":
            yield m.start(), at, kind, value
        else:
            yield m.start(), at, kind, value.replace("-", "")


def has_cue(text: str) -> bool:
    """Whether _CUE may find something; it takes several times as long."""
    return next(_STARTS.iter(text.lower()), None) is not None


def _cues(text: str) -> Iterator[re.Match]:
    """The matches of _CUE, if has_cue(): tried only where a cue begins."""
    if any(c in text for c in _ODD):
        yield from _CUE.finditer(text) if has_cue(text) else ()
        return
    at = 0
    for spot in sorted({end + 1 - n for end, n in _STARTS.iter(text.lower())}):
        if spot >= at and (m := _CUE.match(text, spot)):
            at = m.end()
            yield m


def _cued(text: str) -> Iterator[tuple[list[str], str]]:
    """The words of names that a cue tells, and their gender."""
    spans = [(m.end(), _RELATION.get((m.group("relation") or "").casefold(), "n")) for m in _cues(text)]
    names = [(m.group(), g) for at, g in spans if (m := _CAPITALS.match(text, at))]
    for m in re.finditer("<(?=[\\w.+%-]+@)", text) if "<" in text and "@" in text else ():
        if before := _BEFORE.search(text[max(m.start() - _WINDOW, 0) : m.end()]):
            names.append((before.group().rstrip('<" '), "n"))
    if not names:
        return
    small = {w.group() for w in re.finditer(_WORD, _AT.sub(" ", text)) if w.group().islower()}
    for name, gender in names:
        words = []
        for w in re.findall(_PART, name):
            if not w[0].isupper():
                break
            if not w.endswith("."):
                words.append(w)
        if len(words) > 1 and not any(w.lower() in small or w.lower() in NO_NAMES or w.casefold() in _GENDER for w in words):
            yield words, gender


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names that a title or a cue tells, and all mentions of their parts."""
    known: dict[str, tuple[str, str, str]] = {}

    def learn(words: list[str], gender: str) -> None:
        for i, w in enumerate(words):
            what, word = "surname" if i == len(words) - 1 else "given", w.lower()
            if len(word) > 1 and known.get(word, ("", "", "n"))[2] == "n":
                known[word] = (known.get(word, (what,))[0], script(w), gender)

    at = 0
    for spot in _TITLED.finditer(text):
        if spot.start() < at or not (m := _NAME.match(text, spot.start())):
            continue
        kept, at = [], m.end("title")
        for w in re.finditer(_PART, m.group("name")):
            if w.group()[0].islower():
                break
            if not w.group().endswith("."):
                kept.append(w.group())
            at = m.start("name") + w.end()
        genders = [_GENDER[t.casefold()] for t in re.findall(rf"(?:{_TITLE})(?=\.? )", m.group("title"))]
        learn(kept, next((g for g in genders if g != "n"), "n"))
    for words, gender in _cued(text):
        learn(words, gender)
    if not known:
        return

    def kind(word: str) -> str:
        what, form, gender = known[word]
        # a surname of a script whose surnames have one form is one person's or a couple's
        ends = SURNAME_ENDS.get(form, {})
        return f"{what}:{form}:{gender if what == 'given' or len(set(ends.values())) > 1 else 'm'}"

    for w in re.finditer(_WORD, text):
        whole = w.group().lower()
        if whole in known:
            if not w.group()[0].islower():
                yield w.start(), w.end(), kind(whole), whole
        elif "-" in whole:
            for p in _LETTERS.finditer(w.group()):
                if p.group().lower() in known and not p.group()[0].islower():
                    yield w.start() + p.start(), w.start() + p.end(), kind(p.group().lower()), p.group().lower()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of all entities, in order, without overlaps."""
    if not (_PLAIN.search(text) or "eyJ" in text or "::" in text or _TITLED.search(text) or has_cue(text)):
        return []
    found = [*_numbers(text), *_names(text)]
    if "@" in text:
        found += [(m.start(), m.end(), "email", m.group().lower()) for m in _AT.finditer(text)]
    found.sort(key=lambda e: (e[0], -e[1]))
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def render(original: str, kind: str, new: str) -> str:
    """new in the format of the original: its separators and its case."""
    if kind.startswith(("given", "surname")):
        return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()
    if kind == "ip6":
        padded = re.search("(?:^|:)0[0-9A-Fa-f]{3}(?::|$)", original)
        groups = new if padded else ":".join(f"{int(g, 16):x}" for g in new.split(":"))
        new = ipaddress.IPv6Address(new).compressed if "::" in original else groups
        return new.upper() if original.upper() == original else new
    if kind in ("ip", "token"):
        return new
    if kind in ("email", "secret"):
        if original.isupper() or len(new) != len(original):
            return new.upper() if original.isupper() else new
        return "".join(n.upper() if o.isupper() and n.isalpha() else n for o, n in zip(original, new))
    left = iter(re.sub(r"\D", "", original)[: _phone(original)[1]] + new if kind == "phone" else new)
    return "".join(next(left) if c.isalnum() else c for c in original) + "".join(left)


def replace(text: str, variants: dict[tuple[str, str], int], key: bytes, kinds: dict[tuple[str, str], str] | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had. kinds: those that the corpus gives
    entities in place of their own; variants has the former. key: of fixed_length()."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canonical in found:
        kind = kinds.get((kind, canonical), kind) if kinds else kind
        new = surrogate(kind, canonical, variants.get((kind, canonical), 0), key)
        out += [text[at:start], render(text[start:end], kind, new)]
        at = end
    return "".join(out) + text[at:], len(found)


_PAIR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType())])


def _values(texts: pa.Array, some: int = 256) -> Iterator[str]:
    for i in range(0, len(texts), some):
        for value in texts.slice(i, some).to_pylist():
            yield value or ""


@F.arrow_udf(T.ArrayType(_PAIR))
def _entities(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "canonical": c} for k, c in sorted({e[2:] for e in entities(t)})] for t in _values(texts)]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("canonical", pa.string())])))


def known_genders(docs: DataFrame) -> DataFrame:
    """kind, canonical and as_kind of all entities: as_kind is kind but for names whose gender their
    document doesn't tell and most documents with that name do."""
    found = docs.select(F.explode(_entities("text")).alias("e")).groupBy("e.kind", "e.canonical").agg(F.count("*").alias("n"))
    found = materialize(found.withColumn("stem", group()).withColumn("gender", F.regexp_extract("kind", ":([mfn])$", 1)), "entities", True)
    of = lambda g: F.sum(F.when(F.col("gender") == g, F.col("n")).otherwise(0))
    told = found.filter("gender in ('m', 'f')").groupBy("stem", "canonical").agg(of("m").alias("m"), of("f").alias("f"))
    told = told.filter("m <> f").select("stem", "canonical", F.when(F.col("m") > F.col("f"), "m").otherwise("f").alias("as"))
    open_ = found.filter("gender = 'n'").join(told, ["stem", "canonical"], "left")
    as_kind = F.when(F.col("as").isNull(), F.col("kind")).otherwise(F.concat("stem", F.lit(":"), "as"))
    sure = found.filter("gender <> 'n'").select("kind", "canonical", F.col("kind").alias("as_kind"))
    named = materialize(open_.select("kind", "canonical", as_kind.alias("as_kind")).unionByName(sure), "kinds", True)
    discard(found)
    return named


def group() -> Column:
    """Within what surrogates must differ: the kind, names' without the gender."""
    return F.regexp_replace("kind", ":[mfn]$", "")


def exceptions(docs: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, canonical, as_kind, variant of the entities that get another kind (see known_genders), or
    whose first surrogate collides with an entity of the corpus or with that of a lesser one."""
    held = docs.sparkSession.sparkContext.broadcast(fixed_length(key))

    @F.arrow_udf(T.StringType())
    def surrogates(kinds: pa.Array, canonical: pa.Array, variants: pa.Array) -> pa.Array:
        rows = zip(kinds.to_pylist(), canonical.to_pylist(), variants.to_pylist())
        return pa.array([surrogate(*row, held.value) for row in rows], pa.string())

    def draw(rows: DataFrame, name: str) -> DataFrame:
        new = surrogates("kind", "canonical", "variant").alias("new")
        return materialize(rows.select("kind", "canonical", "variant", group().alias("group"), new), name, True)

    entity, place = ["kind", "canonical"], ["group", "new"]
    named = known_genders(docs)
    first = draw(named.select(F.col("as_kind").alias("kind"), "canonical").distinct().withColumn("variant", F.lit(0)), "surrogates")
    real = first.select("group", F.col("canonical").alias("new"))
    drawn, moved = first, None  # what the last round computed, and all that have left their first surrogate
    for _ in range(rounds):
        now = first
        if moved is not None:
            now = first.join(moved.select(entity), entity, "left_anti").unionByName(moved)
            now = now.join(drawn.select(place), place, "left_semi")
        shared = now.groupBy(place).agg(F.count("*").alias("n"), F.min(F.struct("canonical", "kind")).alias("least")).filter("n > 1")
        late = now.join(shared, place).filter("struct(canonical, kind) <> least").select(entity)
        bad = drawn.join(real, place, "left_semi").select(entity).union(late).distinct()
        again = draw(now.join(bad, entity, "left_semi").withColumn("variant", F.col("variant") + 1), "again")
        if again.isEmpty():
            break
        both = again if moved is None else moved.join(again.select(entity), entity, "left_anti").unionByName(again)
        olds = [t for t in (drawn, moved) if t is not None and t is not first]
        drawn, moved = again, materialize(both, "moved", True)
        for old in olds:
            discard(old)
    else:
        raise RuntimeError(f"{again.count()} entities have no surrogate of their own after {rounds} variants: their domains are full")
    odd = named.withColumn("variant", F.lit(0)).filter("kind <> as_kind")
    if moved is not None:
        later = moved.select(F.col("kind").alias("as_kind"), "canonical", "variant")
        odd = named.join(later, ["as_kind", "canonical"], "left").filter("kind <> as_kind OR variant IS NOT NULL")
    odd = materialize(odd.select("kind", "canonical", "as_kind", F.coalesce("variant", F.lit(0)).alias("variant")), "exceptions", True)
    for old in {id(t): t for t in (named, first, drawn, moved, again) if t is not None}.values():
        discard(old)
    return odd


def _maps(rows: list) -> tuple[dict, dict]:
    variants = {(r["as_kind"], r["canonical"]): r["variant"] for r in rows if r["variant"]}
    return variants, {(r["kind"], r["canonical"]): r["as_kind"] for r in rows if r["kind"] != r["as_kind"]}


def with_surrogates(docs: DataFrame, key: bytes, most: int = BROADCAST, rounds: int = ROUNDS, hot: int = 1000) -> DataFrame:
    """docs with text replaced and a new column entities, how many each text had. hot: with more
    than most exceptions, the rows of a text from which on it may be broadcast."""
    odd = exceptions(docs, key, rounds)
    context = docs.sparkSession.sparkContext
    own = context.broadcast(fixed_length(key))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", T.IntegerType())])

    def changed(texts: pa.Array, each: Iterator[tuple[dict, dict]]) -> pa.Array:
        rows = [replace(t, v, own.value, k) for t, (v, k) in zip(_values(texts), each)]
        new = pa.array([r[0] for r in rows], pa.string())
        new = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), new)
        return pa.StructArray.from_arrays([new, pa.array([r[1] for r in rows], pa.int32())], ["text", "entities"])

    if odd.count() <= most:
        held = context.broadcast(_maps(odd.collect()))

        @F.arrow_udf(schema)
        def apply(texts: pa.Array) -> pa.Array:
            return changed(texts, iter(lambda: held.value, None))

        done = docs.withColumn("__new", apply("text"))
    else:
        keyed = docs.withColumn("__hash", F.xxhash64("text"))
        each = keyed.select("__hash", F.explode(_entities("text")).alias("e")).distinct()
        each = each.select("__hash", "e.kind", "e.canonical").join(odd, ["kind", "canonical"])
        lists = each.groupBy("__hash").agg(F.collect_list(F.struct("kind", "canonical", "as_kind", "variant")).alias("__odd"))
        counts = materialize(keyed.groupBy("__hash").agg(F.count("*").alias("n")), "texts", True)
        total = counts.agg(F.sum("n")).first()[0] or 0
        heavy = counts.filter(F.col("n") > max(total * HOT_SHARE, hot)).select("__hash")  # at most 1 / HOT_SHARE

        @F.arrow_udf(schema)
        def apply_own(texts: pa.Array, rare: pa.Array) -> pa.Array:
            return changed(texts, (_maps(row or []) for row in rare.to_pylist()))

        many = keyed.join(F.broadcast(heavy.join(lists, "__hash", "left")), "__hash")
        few = keyed.join(F.broadcast(heavy), "__hash", "left_anti").join(lists, "__hash", "left")
        done = many.unionByName(few).withColumn("__new", apply_own("text", "__odd"))
    columns = [F.col("__new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns, F.col("__new.entities").alias("entities"))


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced, and n_chars, where it is there, made anew."""
    done = with_surrogates(wrapped(docs, "text"), key)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")
