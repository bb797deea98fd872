"""Format-preserving pseudonyms for numbers, dates and addresses that identify people.

What is found is validated first (check digits, ranges, calendars); only then its
value is permuted by a keyed Feistel network within the values of the same format.
Equal values give equal pseudonyms in every document, however they are punctuated,
and whoever holds the key can turn a pseudonym back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import Memo, map_rows, pick

ROUNDS = 10
FIRST_DAY = datetime.date(1800, 1, 1).toordinal()
DAYS = 146_097  # 400 years


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size, one per ``tweak``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, turn: int, half: int, bits: int) -> int:
        data = f"{tweak}|{turn}|{half}".encode()
        digest = hashlib.blake2b(data, key=self.key, digest_size=bits // 8 + 1).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _walk(self, value: int, size: int, tweak: str, turns: range) -> int:
        """Halves of the bits take turns in changing the other; outside the size, go on."""
        bits = max(2, (size - 1).bit_length())
        high, low = bits // 2, bits - bits // 2
        while True:
            left, right = value >> low, value & ((1 << low) - 1)
            for turn in turns:
                if turn % 2:
                    right ^= self._mix(tweak, turn, left, low)
                else:
                    left ^= self._mix(tweak, turn, right, high)
            value = left << low | right
            if value < size:
                return value

    def forward(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, range(ROUNDS))

    def back(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, range(ROUNDS - 1, -1, -1))


def luhn(payload: str) -> str:
    """The check digit that makes ``payload`` a card number."""
    total = 0
    for i, digit in enumerate(reversed(payload)):
        value = int(digit) * (2 - i % 2)
        total += value - 9 * (value > 9)
    return str(-total % 10)


def iban_rest(text: str) -> int:
    """The value of an account number modulo 97, its first four characters last."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(shape: str, digits: str) -> str:
    """Put ``digits`` where ``shape`` has digits."""
    supply = iter(digits)
    return re.sub(r"\d", lambda _: next(supply), shape)


class Formats:
    """Each kind: None when the found text is not valid, else its pseudonym."""

    def __init__(self, permute):
        self.permute = permute

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self.permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        payload = self._digits(digits[:-1], "card")
        return _refill(text, payload + luhn(payload))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self._mixed(plain[4:], f"iban{plain[:2]}")
        check = 98 - iban_rest(plain[:2] + "00" + body)
        supply = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(supply) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        area, group, serial = text.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
        value = self.permute(value, len(areas) * 99 * 9999, "ssn")
        value, last = divmod(value, 9999)
        first, middle = divmod(value, 99)
        return f"{areas[first]:03d}-{middle + 1:02d}-{last + 1:04d}"

    def phone(self, text: str) -> str | None:
        lead = re.match(r"\+\d{1,3}(?=\D)", text)
        lead = lead[0] if lead else ""
        digits = re.sub(r"\D", "", text[len(lead):])
        if not 8 <= len(digits) + len(lead) - bool(lead) <= 15:
            return None
        return lead + _refill(text[len(lead):], self._digits(digits, f"phone{lead if lead != '+1' else ''}"))

    def date(self, text: str) -> str | None:
        one, mark, two, three = re.match(r"(\d+)(\D)(\d+)\D(\d+)", text).groups()
        if len(one) == 4:
            order, parts = "ymd", (one, two, three)
        else:
            first_is_day = int(one) > 12 or (mark != "/" and int(two) <= 12)
            order, parts = ("dmy" if first_is_day else "mdy"), (one, two, three)
        named = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(*(int(named[k]) for k in "ymd")).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + self.permute(day, DAYS, "date"))
        value = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(str(value[k]).zfill(len(p)) for k, p in zip(order, parts, strict=True))

    def _mixed(self, text: str, tweak: str) -> str:
        """Letters stay letters, digits digits, anything else itself."""
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
        value, size = 0, 1
        for c, n in zip(text, sizes, strict=True):
            value = value * n + (0 if n == 1 else int(c) if n == 10 else ord(c.lower()) - 97)
            size *= n
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "a", re.sub(r"\d", "0", text)))
        value = self.permute(value, size, f"{tweak}|{shape}") if size > 1 else value
        out = []
        for c, n in zip(reversed(text), reversed(sizes), strict=True):
            value, left = divmod(value, n)
            new = c if n == 1 else str(left) if n == 10 else chr(97 + left)
            out.append(new.upper() if c.isupper() else new)
        return "".join(reversed(out))

    def email(self, text: str) -> str | None:
        name, _, host = text.rpartition("@")
        return f"{self._mixed(name, 'email' + host.lower())}@{host}"


#: Fixed shapes, the first that matches and is valid at a place wins.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|"
             r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
PATTERNS = {kind: re.compile(shape) for kind, shape in SHAPES.items()}
#: Kinds with a check digit whose groups may be followed by groups of something else (an expiry, a code, BIC, a year).
GROUPED = {"card", "iban"}
#: Where something may begin; everything else is skipped without trying the shapes.
BEGIN = re.compile(r"[0-9]|[+(][0-9]|[A-Z]{2}[0-9]{2}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@")


def candidates(kind: str, text: str, at: int) -> Iterator[re.Match]:
    """What may be a value of the kind at this place; numbers in groups also without their last groups, longest first."""
    pattern = PATTERNS[kind]
    hit = pattern.match(text, at)
    if hit:
        yield hit
        for end in range(hit.end() - 1, at, -1) if kind in GROUPED else ():
            if text[end] in " -" and (shorter := pattern.fullmatch(text, at, end)):
                yield shorter


def replace(text: str, formats: Formats, memo: dict) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and per finding its kind, start and length in the old text, and pseudonym."""
    found, out, done, at = [], [], 0, 0
    while start := BEGIN.search(text, at):
        at = start.start()
        for kind in PATTERNS:
            hit = next((h for h in candidates(kind, text, at) if memo[kind, h[0]]), None)
            if hit:
                new = memo[kind, hit[0]]
                found.append((kind, at, len(hit[0]), new))
                out += text[done:at], new
                done = at = hit.end()
                break
        else:
            at += 1
    return "".join(out) + text[done:], found


def pseudonymise(df: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """``(doc_id, text, n_found, found)`` for every whole text; ``back`` turns pseudonyms into values again.

    ``found`` lists kind, start, length (code points of the text read) and what was put
    there.  Null texts give an empty text; numbers that fail their check stay as they are; equal
    rows give equal rows.  One narrow pass; nothing is gathered.
    """
    def run(rows):
        feistel = Feistel(key)
        formats = Formats(feistel.back if back else feistel.forward)
        memo = Memo(lambda hit: getattr(formats, hit[0])(hit[1]), 16 << 20)
        for i, t in rows:
            new, found = replace(t or "", formats, memo)
            yield i, new, len(found), [dict(zip(("kind", "start", "length", "pseudonym"), f, strict=True)) for f in found]

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run, f"doc_id {kind}, text string, n_found int, "
                    "found array<struct<kind:string,start:int,length:int,pseudonym:string>>", 500)
