"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

Found values are validated (card numbers by their check digit, account numbers by their check
number, dates by the calendar, addresses and phone numbers by their parts) and replaced by another
valid value of the same format: their digits and letters are one number below the product of their
alphabets, which the network permutes; while the image is not valid it is permuted again (cycle
walking), which makes a permutation of the valid values.  So equal values get equal pseudonyms in all
documents, different values different ones, punctuation and case stay, and who has the key can go back.

Kinds: email (the part before the @), phone, ip (of both versions), date (years 1000 to 2999), ssn, iban, card,
and secret (hexadecimal credentials after token =, key =, password = and the like).

One value has one pseudonym however it is written:

* dates are one day in every form (2024-12-25, 25.12.2024, 12/25/2024, 25/12/2024, Dec 25, 2024, 25 December 2024;
  with slashes month/day where that is a date, else day/month).  The years 1900 to 2099 and the
  others are permuted apart, and so are days up to 12 and later ones, since only the later tell day and month apart.
  May is a full name;
* phone numbers are their digits: those of North America (ten digits, also after 1 or +1) their ten, others (after +)
  all of them, with the country code, which no pseudonym keeps;
* addresses of IPv6 are 128 bits; a pseudonym is written out where the value is, else in short form;
* letters of email addresses keep their case and are equal in both; letters beyond ASCII become others of the same
  kind among their block of 256 code points.

Phone numbers begin with + or are of three, three and four digits set apart by brackets, hyphens, dots or
spaces; other national forms are not looked for.  IPv6 addresses need a digit and two groups, so that a::b and :: stay.

Defined cases: a null text stays null and an empty one empty; values that fail validation stay; an
input column named like a new one is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, map_arrow, named

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most remembered pseudonyms of a worker.
MEMO_VALUES = 100_000

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]}|\\.)?" if m[3:] else m for m in MONTHS) + ")"
#: What may hold a value at all.
HINT = re.compile("[0-9@]")
FOUND = re.compile((
    r"(?P<email>(?<![\w.%+-])[^\W_][\w.%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?P<secret>\b(?i:token|secret|password|passwd|api[_-]?key|key)\s{0,3}[=:]\s{0,3}[\"']?(?P<hex>[0-9A-Fa-f]{16,})(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?(?!\d{1,3}(?:\.\d{1,3}){3})\d{2,4}){1,4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w+.-])(?:1[-. ])?[2-9]\d\d(?:-\d{3}-|\.\d{3}\.| [2-9]\d\d )\d{4}(?![\w-]|\.\d))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4})(?![\w:]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-])"
    rf"|\b{_MONTH} \d{{1,2}},? \d{{4}}(?!\d)|(?<![\w./-])\d{{1,2}}\.? {_MONTH},? \d{{4}}(?!\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\d-]))"
    r"|(?P<iban>\b[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]?\d))"
).replace(r"[\d", "[0-9").replace(r"\d", "[0-9]"))
#: What is passed over where an account number is not valid; the rest of it may hold other values.
DIGITS_ONLY = re.compile(r"[A-Z]{2}\d\d(?: ?\d{4}){2,7}(?: ?\d{1,3})?(?!\w)")


def _half(key: bytes, tweak: bytes, number: int, value: int, bits: int) -> int:
    """The round function: bits keyed bits of a value."""
    out, size = 0, (bits + 7) // 8
    data = value.to_bytes(size, "big")
    blob = b"".join(hashlib.blake2b(b"%d,%d;" % (number, k) + data, key=key, digest_size=64, person=tweak).digest() for k in range((size + 63) // 64))
    out = int.from_bytes(blob[:size], "big")
    return out & ((1 << bits) - 1)


def permuted(value: int, size: int, key: bytes, tweak: bytes, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """The image of value under the keyed permutation of the valid numbers below size."""
    if size < 2:
        return value
    bits = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << bits) - 1
    while True:
        a, b = value >> bits, value & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ _half(key, tweak, k, a, bits), a
            else:
                a, b = b, a ^ _half(key, tweak, k, b, bits)
        value = a << bits | b
        if value < size and valid(value):
            return value


def _other_case(c: str) -> str | None:
    """The letter that c is in the other case, if it is one of the same block that goes back to c."""
    other = c.upper() if c.islower() else c.lower()
    return other if len(other) == 1 and other != c and ord(other) >> 8 == ord(c) >> 8 and (other.lower() if c.islower() else other.upper()) == c else None


@cache
def _alphabet(c: str) -> str:
    """The characters that c is one of: digits, letters of a case, or its category in its block beyond ASCII, where
    letters that have another case are apart and in one order in both."""
    for letters in (DIGITS, LOWER, UPPER):
        if c in letters:
            return letters
    first = ord(c) & ~0xFF
    block = [x for x in map(chr, range(max(first, 0x80), first + 0x100)) if x.isalnum()]
    if _other_case(c) is None:
        return "".join(x for x in block if unicodedata.category(x) == unicodedata.category(c) and _other_case(x) is None)
    small = [x for x in block if x.islower() and _other_case(x) is not None]
    return "".join(small if c.islower() else map(_other_case, small))


def _number(chars: str) -> tuple[int, int]:
    """The letters and digits of chars as one number, and how many such numbers there are."""
    value, size = 0, 1
    for c in chars:
        alphabet = _alphabet(c)
        value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    return value, size


def _spelt(value: int, like: str) -> str:
    out = []
    for c in reversed(like):
        alphabet = _alphabet(c)
        value, k = divmod(value, len(alphabet))
        out.append(alphabet[k])
    return "".join(reversed(out))


def _filled(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced, in order."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in shape)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _nanp(digits: str) -> bool:
    """Whether ten digits are a number of North America; the middle three are taken as they are written."""
    return len(digits) == 10 and digits[0] > "1"


DATES = (("-", 0, 1, 2), (".", 2, 1, 0), ("/", 2, 0, 1), ("/", 2, 1, 0))
FIRST_DAY, DAYS = datetime.date(1000, 1, 1).toordinal(), datetime.date(3000, 1, 1).toordinal() - datetime.date(1000, 1, 1).toordinal()
NAMED = re.compile(rf"(?P<before>{_MONTH})? ?(?P<day>[0-9]{{1,2}})(?P<mark>[.,]?) ?(?P<after>{_MONTH})?(?P<comma>,?) (?P<year>[0-9]{{4}})")


def _day(number: int) -> datetime.date:
    return datetime.date.fromordinal(FIRST_DAY + number)


def _kind_of_day(number: int) -> tuple[bool, bool]:
    day = _day(number)
    return 1900 <= day.year < 2100, day.day > 12


def _date(year: str, month: str | int, day: str) -> int | None:
    """The number of a day, None if there is no such day."""
    try:
        number = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return number if 0 <= number < DAYS else None


class Pseudonyms:
    """Replaces the values of texts."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("an empty key")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.memo: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or what has it, going back), None if it isn't valid."""
        tweak = kind.encode()
        if kind == "date":
            return self._dated(text, back)
        if kind == "ip" and ":" in text:
            try:
                value = ipaddress.IPv6Address(text)
            except ValueError:
                return None
            if not any(c in DIGITS for c in text) or sum(map(bool, text.split(":"))) < 2:
                return None
            made = ipaddress.IPv6Address(permuted(int(value), 1 << 128, self.key, b"ip6", back=back))
            out = made.exploded if len(text) == 39 else made.compressed
            return out.upper() if text.upper() == text and text.lower() != text else out
        if kind == "ip":
            parts = text.split(".")
            if any(int(p) > 255 or str(int(p)) != p for p in parts):
                return None
            value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, self.key, tweak, back=back)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "hex":
            lower = text.lower()
            value = permuted(int(lower, 16), 16 ** len(lower), self.key, tweak + b"%d" % min(len(lower), 999), back=back)
            made = f"{value:0{len(lower)}x}"
            return "".join(c.upper() if c.isalpha() and text.isupper() else c for c in made) if text in (lower, text.upper()) else made
        if kind == "email":
            name, at, host = text.partition("@")
            chars = "".join(c for c in name if c.isalnum())
            value, size = _number(chars)
            return _filled(name, _spelt(permuted(value, size, self.key, tweak, back=back), chars)) + at + host
        chars = "".join(c for c in text if c.isalnum())
        keep, check = 0, lambda _: True
        if kind == "phone":
            if not 8 <= len(chars) <= 15:
                return None
            national, plus = chars[-10:], text[0] == "+"
            if _nanp(national) and (len(chars) == 10 and not plus or len(chars) == 11 and chars[0] == "1"):
                # Equal in all its forms.  Those with the middle that is usual stay such, so that they are found again.
                keep, usual = len(chars) - 10, national[3] > "1"
                check = lambda d: _nanp(d) and (d[3] > "1") == usual
            elif not plus or chars[0] == "0":
                return None
            else:
                check = lambda d: d[0] != "0" and not (len(d) == 11 and d[0] == "1" and _nanp(d[1:]))
        elif kind == "ssn":
            check = _ssn
        elif kind == "card":
            check = luhn
            if set(chars) == {"0"}:
                return None
        elif kind == "iban":
            if _iban_rest(chars) != 1:
                return None
            value, size = _number(chars[4:])
            body = _spelt(permuted(value, size, self.key, tweak, back=back), chars[4:])
            return _filled(text, f"{chars[:2]}{98 - _iban_rest(chars[:2] + '00' + body):02d}{body}")
        body = chars[keep:]
        if not check(body):
            return None
        value, size = _number(body)
        made = permuted(value, size, self.key, tweak, lambda v: check(_spelt(v, body)), back)
        return _filled(text, chars[:keep] + _spelt(made, body))

    def _dated(self, text: str, back: bool) -> str | None:
        """A date in any form: the day is permuted among those of its kind."""

        def image(number: int) -> datetime.date:
            kind = _kind_of_day(number)
            return _day(permuted(number, DAYS, self.key, b"date", lambda v: _kind_of_day(v) == kind, back))

        for mark, year, month, day in DATES:
            parts = text.split(mark)
            if len(parts) == 3 and " " not in text and (number := _date(parts[year], parts[month], parts[day])) is not None:
                made = image(number)
                parts[year], parts[month], parts[day] = f"{made.year:04d}", f"{made.month:02d}", f"{made.day:02d}"
                return mark.join(parts)
        m = NAMED.fullmatch(text)
        name = m and (m["before"] or m["after"])
        if not name or m["before"] and m["after"]:
            return None
        number = _date(m["year"], 1 + [x[:3].lower() for x in MONTHS].index(name[:3].lower()), m["day"])
        if number is None:
            return None
        made = image(number)
        full = MONTHS[made.month - 1]
        new = full if name.lower() in (x.lower() for x in MONTHS) else full[:3] + name[3:]
        new = new.upper() if name.isupper() else new.lower() if name.islower() else new
        day = f"{made.day:02d}" if m["day"][0] == "0" else str(made.day)
        a, b, c, d = *m.span("day"), *m.span("year")
        spot = m.span("before") if m["before"] else m.span("after")
        pieces = sorted([(spot, new), ((a, b), day), ((c, d), f"{made.year:04d}")])
        out, at = [], 0
        for (start, stop), piece in pieces:
            out += [text[at:start], piece]
            at = stop
        return "".join([*out, text[at:]])

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and the kind, start and end of each value in the source."""
        spans: list[tuple[str, int, int]] = []
        if not HINT.search(text):
            return text, spans

        out, done, pos = [], 0, 0
        while m := FOUND.search(text, pos):
            kind = m.lastgroup if m.lastgroup != "hex" else "secret"
            name = "hex" if kind == "secret" else kind
            at, found = m.start(name), m[name]
            made, pos = self._known(name, found), m.end()
            if kind == "iban":
                # Words in capitals or numbers may follow.
                while made is None and " " in found:
                    found = found.rpartition(" ")[0]
                    made = self._known(name, found) if len(found) > 11 else None
                digits = DIGITS_ONLY.match(text, at)
                pos = at + len(found) if made is not None else digits.end() if digits else at + 4
            if made is None and ":" in found and kind == "ip":
                pos = at + found.index(":") + 1  # times and the like: what follows may be a value
            if made is not None:
                spans.append((kind, at, at + len(found)))
                out += [text[done:at], made]
                done = at + len(found)
        return "".join([*out, text[done:]]), spans

    def _known(self, name: str, found: str) -> str | None:
        known = (name, found)
        if known not in self.memo:
            if len(self.memo) > MEMO_VALUES:
                self.memo.clear()
            self.memo[known] = self.value(name, found)
        return self.memo[known]


NEW = "text string, n_private long, spans array<struct<kind: string, start: int, stop: int>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text, and n_private and spans (of the source text, in characters)."""
    bounded_batches(docs.sparkSession)
    Pseudonyms(key)  # an empty key is refused here, not in a task
    new = T.StructType.fromDDL(NEW)
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in new}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new.fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, spans = [], []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                made, found = (None, []) if text is None else names.text(text)
                texts.append(made)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], schema.names)

    return map_arrow(docs.select(*named(kept), F.col("text").cast("string").alias(fresh(docs, "text"))), run, schema)
