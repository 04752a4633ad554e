"""Format-preserving Feistel pseudonyms for personal data.

Every value found is replaced by a keyed permutation of its own format: a value maps to one value of the same length and
layout, different values map to different ones, and equal values stay equal in every document, so links are
kept. A balanced Feistel network of ten rounds with a keyed BLAKE2 round function permutes the numbers below
the format's size; numbers outside are walked on until they fall inside (cycle walking), which keeps it a
permutation. Nothing but the key is shared between tasks, so any task gives the same result at any time.

What is found, and what stays valid:

- payment card numbers of 13 to 19 digits that are issued like this and have a right Luhn sum, plain or in groups, also next
  to other numbers: digits permuted, sum right again;
- IBANs with right check digits, also before other words: account part permuted, check digits right again;
- telephone numbers in international or North American form: digits after the country code;
- social security numbers (3-2-4 digits, valid areas); IPv4 addresses with octets up to 255: the 32-bit address;
  IPv6 addresses: their hex digits;
- calendar dates (1900 to 2099; ISO, slashes, points): another day of those years in the same layout;
- e-mail addresses: letters and digits of the local part, of any alphabet; keys, tokens and passwords: letters, digits and hex
  digits, up to white space or the closing quote, from eight characters on, or from four with a digit among them.

Numbers that fail their check (a wrong Luhn sum, an octet of 300, the 31st of February) stay as they are. Digits of other
scripts count as digits. Letters keep their case. The text's length never changes. Null texts stay null; empty ones empty. Repeated rows are treated alike;
other columns are handed on. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import only

ROUNDS = 10
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Longer letters and digits are permuted in blocks of this length, each under the values of those before it.
BLOCK = 128
CACHE = 50_000


class Feistel:
    """Keyed permutations of the numbers 0 .. size-1."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: bytes, turn: int, half: int, mask: int) -> int:
        block = hashlib.blake2b(turn.to_bytes(1, "big") + half.to_bytes(40, "big") + tweak, key=self.key, digest_size=40)
        return int.from_bytes(block.digest(), "big") & mask

    def permute(self, value: int, size: int, tweak: str) -> int:
        if not 0 <= value < size:
            raise ValueError("value outside its format")
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, name = (1 << half) - 1, f"{tweak}/{size}".encode()
        while True:
            left, right = value >> half, value & mask
            for turn in range(ROUNDS):
                left, right = right, left ^ self._round(name, turn, right, mask)
            value = left << half | right
            if value < size:
                return value

    def digits(self, text: str, tweak: str) -> str:
        return str(self.permute(int(text), 10 ** len(text), tweak)).zfill(len(text)) if text else text

    def characters(self, text: str, tweak: str) -> str:
        """Permutes letters among letters of their case (and alphabet) and digits among digits; other characters stay."""
        if len(text) > BLOCK:
            return self._blocks(self.characters, text, tweak)
        value, size, classes = 0, 1, []
        for c in text:
            alike = "0123456789" if "0" <= c <= "9" else LOWER if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else relatives(c)
            classes.append(alike)
            value, size = value * len(alike) + alike.index(c), size * len(alike)
        if size == 1:
            return text
        value, out = self.permute(value, size, f"{tweak}:{''.join(alike[0] for alike in classes)}"), []
        for alike in reversed(classes):
            value, at = divmod(value, len(alike))
            out.append(alike[at])
        return "".join(reversed(out))

    def _blocks(self, change: Callable[[str, str], str], text: str, tweak: str) -> str:
        """Block by block, each under a hash of the blocks before it: different values stay different at any length."""
        out, before = [], hashlib.blake2b(tweak.encode(), key=self.key)
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            out.append(change(part, f"{tweak}+{before.hexdigest()}" if at else tweak))
            before.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def hexadecimal(self, text: str, tweak: str) -> str:
        if len(text) > BLOCK:
            # Blocks of digits alone have no case of their own.
            changed = self._blocks(self.hexadecimal, text.lower(), tweak)
            return changed.upper() if text.upper() == text else changed.lower()
        changed = f"{self.permute(int(text, 16), 16 ** len(text), tweak):0{len(text)}x}"
        return changed.upper() if text.upper() == text else changed


@functools.lru_cache(4096)
def relatives(c: str) -> str:
    """Letters, digits and accents outside ASCII of the same kind in the same block of 128 characters; any other character alone."""
    kind = unicodedata.category(c)
    if c.isascii() or kind[0] not in "LNM":
        return c
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(max(start, 128), start + 128)) if unicodedata.category(x) == kind)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(layout: str, digits: str) -> str:
    """Digits of ``layout`` replaced one by one."""
    at = iter(digits)
    return "".join(next(at) if "0" <= c <= "9" else c for c in layout)


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


# Groups that cards are printed in (a card in one group counts as well), and IBAN lengths by country.
PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
LENGTHS = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


# First digits (from, to) and lengths of the cards that are issued.
ISSUED = [(first, last, set(lengths)) for first, last, lengths in (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)),
    ("6011", "6011", range(16, 20)), ("644", "649", range(16, 20)), ("65", "65", range(16, 20)), ("300", "305", range(14, 20)),
    ("3095", "3095", range(14, 20)), ("36", "36", range(14, 20)), ("38", "39", range(14, 20)), ("3528", "3589", range(16, 20)),
    ("62", "62", range(16, 20)), ("2200", "2204", range(16, 20)), ("5018", "5018", range(13, 20)), ("5020", "5020", range(13, 20)),
    ("5038", "5038", range(13, 20)), ("5893", "5893", range(13, 20)), ("6304", "6304", range(13, 20)), ("6759", "6759", range(13, 20)),
    ("6761", "6763", range(13, 20)), ("60", "60", (16,)), ("81", "82", (16,)), ("508", "508", (16,)), ("636", "636", range(16, 20)),
    ("9792", "9792", (16,)))]


def issued(digits: str) -> bool:
    """Whether cards of this length begin like this."""
    return any(first <= digits[: len(first)] <= last and len(digits) in lengths for first, last, lengths in ISSUED)


def card_windows(run: str, printed: bool = False) -> list[tuple[int, int]]:
    """Places of cards in a run of digit groups: 13 to 19 digits of whole groups, as issued, with a right Luhn sum.

    Of windows that overlap, those in a usual layout (one kind of gap, first digit of 2 to 6) come first, then longer ones,
    then earlier ones. ``printed`` leaves out the others.
    """
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    found = []
    for k in range(len(groups)):
        size = 0
        for j in range(k, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            usual = run[groups[k][0]] in "23456" and (j == k or tuple(b - a for a, b in groups[k : j + 1]) in PRINTED and len(
                {run[b] for _, b in groups[k:j]}) == 1)
            plain = re.sub(r"[ -]", "", run[groups[k][0] : groups[j][1]]) if size >= 13 and (usual or not printed) else ""
            if plain and issued(plain) and luhn_digit(plain[:-1]) == plain[-1]:
                found.append((not usual, -size, groups[k][0], groups[j][1]))
    taken: list[tuple[int, int]] = []
    for _, _, a, b in sorted(found):
        at = bisect.bisect(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
    return taken


def iban_end(text: str) -> int:
    """Length of the valid IBAN that ``text`` begins with and that ends with one of its groups; 0 where there is none."""
    known = LENGTHS.get(text[:2])
    for inner in re.finditer(" (?=[A-Z]{2}[0-9]{2})", text) if not known else ():
        # A code that is no country's may stand before an IBAN.
        if text[inner.end() : inner.end() + 2] in LENGTHS and iban_end(text[inner.end() :]):
            text = text[: inner.start()]
            break
    ends = {}
    for end in [m.start() for m in re.finditer(" ", text)] + [len(text)]:
        ends[end - text.count(" ", 0, end)] = end
    for size in sorted(ends, key=lambda n: (n != known, -n)):
        plain = text[: ends[size]].replace(" ", "")
        if 15 <= size <= 34 and iban_digits(plain[:2], plain[4:]) == plain[2:4]:
            return ends[size]
    return 0


def _card(f: Feistel, text: str) -> str:
    plain = re.sub(r"[ -]", "", text)
    body = f.digits(plain[:-1], "card")
    return _refill(text, body + luhn_digit(body))


def _iban(f: Feistel, text: str) -> str:
    plain = text.replace(" ", "")
    account = f.characters(plain[4:], "iban" + plain[:2])
    at = iter(plain[:2] + iban_digits(plain[:2], account) + account)
    return "".join(c if c == " " else next(at) for c in text)


def _phone(f: Feistel, text: str) -> str:
    lead = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d\d?", text)
    head = lead[0] if lead else ""
    rest = text[len(head) :]
    plain = re.sub(r"\D", "", rest)
    if not 7 <= len(plain) <= 14:
        return text
    return head + _refill(rest, f.digits(plain, "phone" + head))


def _social(f: Feistel, text: str) -> str:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return text
    areas = [a for a in range(1, 900) if a != 666]
    number = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    number, serial_at = divmod(f.permute(number, len(areas) * 99 * 9999, "social"), 9999)
    area_at, group_at = divmod(number, 99)
    return f"{areas[area_at]:03d}-{group_at + 1:02d}-{serial_at + 1:04d}"


def _address(f: Feistel, text: str) -> str:
    """IPv4: each octet keeps its number of digits, so the length stays."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return text
    ranges = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    value, size = 0, 1
    for p in parts:
        low, count = ranges[len(p)]
        value, size = value * count + int(p) - low, size * count
    value, out = f.permute(value, size, "ip" + "".join(str(len(p)) for p in parts)), []
    for p in reversed(parts):
        low, count = ranges[len(p)]
        value, at = divmod(value, count)
        out.append(str(low + at))
    return ".".join(reversed(out))


def _address6(f: Feistel, text: str) -> str:
    """IPv6: hex digits of every group, whose layout stays."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return text
    if not any(c.isdigit() for c in text) and text.count(":") < 4:
        return text
    at = iter(f.hexadecimal(text.replace(":", ""), "ip6" + re.sub("[^:]", "x", text)))
    return "".join(c if c == ":" else next(at) for c in text)


def _date(f: Feistel, text: str) -> str:
    numbers = re.findall(r"\d+", text)
    year_first = len(numbers[0]) == 4
    year = numbers[0] if year_first else numbers[2]
    others = numbers[1:] if year_first else numbers[:2]
    month_first = year_first or "/" in text and int(others[0]) <= 12
    month, day = others if month_first else others[::-1]
    try:
        date = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return text
    if not 1900 <= date.year <= 2099:
        return text
    # One-digit months and days keep their width: walk on within the permutation until the layout fits.
    place = date.toordinal() - FIRST_DAY
    while True:
        place = f.permute(place, DAYS, "date")
        new = datetime.date.fromordinal(FIRST_DAY + place)
        widths = [len(str(x)) if len(old) == 1 else 2 for x, old in ((new.month, month), (new.day, day))]
        slashed = not year_first and "/" in text
        readable = not slashed or month_first or new.day > 12
        if widths == [len(month), len(day)] and readable:
            break
    pair = [str(new.month).zfill(len(month)), str(new.day).zfill(len(day))]
    pair = pair if month_first else pair[::-1]
    marks = re.findall(r"\D", text)
    values = [str(new.year), *pair] if year_first else [*pair, str(new.year)]
    return values[0] + marks[0] + values[1] + marks[1] + values[2]


def _mail(f: Feistel, text: str) -> str:
    local, domain = text.rsplit("@", 1)
    # Signs before the first letter or digit are no part of the value.
    head = re.match(r"[._%+-]*", local)[0]
    return f"{head}{f.characters(local[len(head) :], 'mail' + domain.lower())}@{domain}"


def _secret(f: Feistel, text: str) -> str:
    head = re.match(r"(?i)(?:AKIA|ASIA)|(?:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?", text)
    head = head[0] if head else ""
    body = text[len(head) :]
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return head + f.hexadecimal(body, "secret")
    return head + f.characters(body, "secret")


# A mail address begins where its characters begin, so a long word is read once. A secret runs to white space or its closing
# quote, without the marks of the sentence.
MAIL = r"[._%+-]*[^\W_][\w.%+\u0300-\u036f-]*+(?<!\.)@(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}"

KINDS: dict[str, tuple[str, Callable[[Feistel, str], str]]] = {
    "mail": (rf"(?<![\w.%+\u0300-\u036f-]){MAIL}", _mail),
    "secret": (r"(?:AKIA|ASIA)[A-Z0-9]{16}\b|(?i:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*"
               r"(?:\"[^\s\"]{8,}(?=\")|'[^\s']{8,}(?=')|[\"']?[^\s\"']{7,}[^\s\"'.,;:!?)\]}>]"
               # Shorter ones need a digit, as words follow such keys in prose.
               r"|[\"']?(?=[^\s\"'\d]{0,6}\d)[^\s\"']{3,6}[^\s\"'.,;:!?)\]}>])"
               r"|\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b", _secret),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "phone": (r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
              r"|(?<![\d.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", _phone),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-]|\.\d)", _date),
    "social": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    "address6": (r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?<=[0-9A-Fa-f])(?![\w:])", _address6),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _address),
    "card": (r"(?<!\d)(?<!\d[.-])\d(?:[ -]?\d){12,}(?!\d|[.-]\d)", _card),
}
# One scan decides whether any kind can occur at all.
HINT = re.compile(r"\d|@|::|(?i:token|passw|secret|api[_-]?key)|A[KS]IA|[A-Fa-f]{40}")
# What a kind begins with: it saves trying the whole pattern elsewhere, and changes nothing that is found.
BEGINS = {"secret": "(?=[A-Fa-fTtPpSs\u017f0-9])", "iban": "(?=[A-Z]{2})", "phone": r"(?=[\d+(])"} | dict.fromkeys(("date", "social", "address", "card"), r"(?=\d)")


def _any(kinds: list[str]) -> re.Pattern:
    return re.compile("|".join(f"{BEGINS.get(k, '')}(?P<{k}>{KINDS[k][0]})" for k in kinds))


FOUND = _any(list(KINDS))
CARD = re.compile(KINDS["card"][0])
MAIL_HERE = re.compile(f"(?P<mail>{MAIL})")
OTHERS = _any([k for k in KINDS if k != "card"])


OTHER_DIGIT = re.compile(r"[^\D0-9]")


def _in_script(old: str, plain: str, new: str) -> str:
    """A new digit in the script of the old one; what has not changed stays as it was."""
    if new == plain:
        return old
    return chr(ord(old) - int(plain) + int(new)) if old != plain and new.isdecimal() else new


class Pseudonyms:
    """Replaces the personal data of texts under one key."""

    def __init__(self, key: str):
        self.feistel = Feistel(key)
        self.value = functools.lru_cache(CACHE)(lambda kind, text: KINDS[kind][1](self.feistel, text))

    def _values(self, text: str, pattern: re.Pattern, at: int, end: int) -> Iterator[tuple[int, int, str]]:
        """Start, end and kind of the values in text[at:end], in order. What fails its check does not hide what follows in it."""
        doubtful, begin = 0, at
        # A mail address may also begin right behind another value.
        while found := (at > begin and MAIL_HERE.match(text, at, end)) or pattern.search(text, at, end):
            kind, start, at = found.lastgroup, found.start(), found.end()
            if kind == "card":
                # Other kinds may lie between the cards of a run of digits.
                for a, b in card_windows(found[0], printed=start < doubtful):
                    yield from self._values(text, OTHERS, start, found.start() + a)
                    start = found.start() + b
                    yield found.start() + a, start, kind
                yield from self._values(text, OTHERS, start, at)
            elif kind == "iban":
                size = iban_end(found[0])
                if size:
                    yield start, start + size, kind
                else:
                    doubtful = at
                at = start + (size or 4)
            else:
                if kind == "phone":
                    at = self._before_card(text, start, at, end)
                yield start, at, kind

    def _before_card(self, text: str, start: int, at: int, end: int) -> int:
        """Where a telephone number ends: at the latest before a card."""
        for gap in re.finditer(r" (?=\d)", text[start:at]):
            card = CARD.match(text, start + gap.end(), end)
            if card and any(a == 0 for a, _ in card_windows(card[0], printed=True)):
                return start + gap.start()
        return at

    def text(self, text: str) -> str:
        """Texts with digits, @ signs or key words are searched whole for all kinds, the others are left alone.

        Decimal digits of any script are read as such, and come back in theirs.
        """
        if not HINT.search(text):
            return text
        plain = text if text.isascii() or not OTHER_DIGIT.search(text) else OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
        parts, done = [], 0
        for start, end, kind in self._values(plain, FOUND, 0, len(plain)):
            changed = self.value(kind, plain[start:end])
            if plain is not text:
                changed = "".join(map(_in_script, text[start:end], plain[start:end], changed))
            parts += [text[done:start], changed]
            done = end
        return "".join([*parts, text[done:]])


@functools.lru_cache(4)
def _pseudonyms(key: str) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The documents with personal data in ``column`` replaced; all other columns as they are.

    The key is a parameter and must be kept secret where the result is shared.
    """

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        only()
        change = _pseudonyms(key).text
        return texts.map(lambda t: change(t) if isinstance(t, str) else None).astype(object)

    return docs.withColumn(column, replaced(F.col(column)))
