import datetime
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import pii_feistel
from tessella.llm.queries import op3_pii_feistel

from .helpers import CLASHING, DATA, ODD, clashing, empty_docs, needs_data, odd_docs, same_columns

NAMES = pii_feistel.Pseudonyms(b"test key")


@given(st.integers(2, 10**12), st.data())
def test_permutation_goes_back(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pii_feistel.permuted(x, size, b"k" * 32, b"t")
    assert 0 <= y < size
    assert pii_feistel.permuted(y, size, b"k" * 32, b"t", back=True) == x


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation_is_one(size):
    even = lambda v: v % 2 == 0
    assert sorted(pii_feistel.permuted(x, size, b"k" * 32, b"t") for x in range(size)) == list(range(size))
    assert sorted(pii_feistel.permuted(x, size, b"k" * 32, b"t", even) for x in range(0, size, 2)) == list(range(0, size, 2))


VALUES = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"[:4] + "37040044053201300"],
    "date": ["2024-02-29", "31.12.1999", "02/28/2001"],
    "ssn": ["123-45-6789"],
    "phone": ["+49 30 1234567", "(212) 555-0187"],
    "ip": ["192.168.0.1", "8.8.8.8"],
    "email": ["Jane.Doe42@example.org"],
    "hex": ["0123456789abcdef0123"],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in VALUES.items() for t in ts])
def test_format_stays_and_values_go_back(kind, text):
    made = NAMES.value(kind, text)
    if made is None:
        assert kind == "iban"  # the second one has a wrong check number
        return
    assert made != text
    if kind != "ip":
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", s)))
        assert kind == "hex" or shape(made) == shape(text)
        assert len(made) == len(text)
    assert NAMES.value(kind, made, back=True) == text
    digits = re.sub(r"\D", "", made)
    if kind == "card":
        assert pii_feistel.luhn(digits)
    if kind == "iban":
        assert pii_feistel._iban_rest(made.replace(" ", "")) == 1
    if kind == "date":
        form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[re.sub(r"\d", "", made)[0]]
        assert datetime.datetime.strptime(made, form)
    if kind == "ip":
        assert all(0 <= int(p) <= 255 for p in made.split("."))
    assert pii_feistel.Pseudonyms(b"another key").value(kind, text) != made


def test_invalid_values_stay():
    for text in ("2023-02-29", "4111 1111 1111 1112", "000-12-3456", "300.1.1.1", "DE00 3704 0044 0532 0130 00", "version 1.2.3", "page 12/13", "1234567890123"):
        assert NAMES.text(text) == (text, [])


def test_values_in_texts():
    text = "Write to bob@example.com or +49 30 1234567, paid by 4111 1111 1111 1111 on 2024-02-29. token = 0123456789abcdef0123"
    made, spans = NAMES.text(text)
    assert [k for k, *_ in spans] == ["email", "phone", "card", "date", "secret"]
    assert [text[a:b] for _, a, b in spans] == ["bob@example.com", "+49 30 1234567", "4111 1111 1111 1111", "2024-02-29", "0123456789abcdef0123"]
    assert not any(text[a:b] in made for _, a, b in spans)
    assert "token = " in made and "@example.com" in made
    # Equal values are equal in another text.
    other, _ = NAMES.text("again 2024-02-29, from bob@example.com")
    assert other.split("from ")[1] in made


@pytest.mark.parametrize(("kind", "text"), [
    ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "GB82WEST12345698765432"), ("iban", "FR14 2004 1010 0505 0001 3M02 606"),
    ("iban", "NL91 ABNA 0417 1643 00"), ("iban", "IE29 AIBK 9311 5212 3456 78"), ("date", "31/12/2024"),
    ("phone", "212-555-0187"), ("phone", "212.555.0187"), ("phone", "1 212 555 0187"),
])
def test_letters_day_first_and_plain_phones(kind, text):
    for around in ("{}", "to {} AND SO ON, 2024", "to {} THEN, sir."):
        whole = around.format(text)
        made, spans = NAMES.text(whole)
        assert [(k, whole[a:b]) for k, a, b in spans] == [(kind, text)]
        value = made[spans[0][1] : spans[0][2]]
        assert value != text and NAMES.value(kind, value, back=True) == text
        assert NAMES.text(made)[1] == spans  # found in the same place again


#: Values in several spellings: all of a line are one value.
SAME = [
    ("phone", ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+44 (20) 7946 0958"]),
    ("phone", ["555-123-4567", "555.123.4567", "(555) 123-4567", "+1 555 123 4567", "1-555-123-4567"]),
    ("phone", ["+1 (212) 555-0187", "212-555-0187", "212 555 0187", "+12125550187"]),
    ("date", ["1999-12-25", "25.12.1999", "25/12/1999", "12/25/1999", "Dec 25, 1999", "25 December 1999", "DEC 25 1999", "25. december 1999"]),
    ("date", ["1999-01-05", "05.01.1999", "01/05/1999", "Jan 5, 1999", "January 05, 1999", "5 jan. 1999"]),
    ("date", ["1899-12-31", "31/12/1899", "December 31, 1899"]),
    ("ip", ["2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "2001:DB8:0:0:0:8A2E:370:7334"]),
    ("email", ["müller@example.org", "MÜLLER@example.org"]),
]


def plain(kind, text):
    """What a spelling stands for, read by other means than the operator's."""
    import ipaddress

    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "ip":
        return ipaddress.ip_address(text).packed
    if kind == "email":
        return text.lower()
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%b %d, %Y", "%B %d, %Y", "%d %B %Y", "%b %d %Y", "%d. %B %Y", "%d %b. %Y", "%d %b %Y", "%B %d %Y", "%d. %b %Y"):
        try:
            return datetime.datetime.strptime(text, form).date()
        except ValueError:
            continue
    raise AssertionError(text)


@pytest.mark.parametrize(("kind", "spellings"), SAME)
def test_one_pseudonym_in_every_spelling(kind, spellings):
    assert len({plain(kind, s) for s in spellings}) == 1
    made = []
    for s in spellings:
        out, spans = NAMES.text(f"so {s}; and")
        assert [(k, a, b) for k, a, b in spans] == [(kind, 3, 3 + len(s))], s
        made.append(out[3:-5])
    assert len({plain(kind, m) for m in made}) == 1, made
    assert plain(kind, made[0]) != plain(kind, spellings[0])
    assert not any(set(re.findall("[^\x00-\x7f]", m)) & set("üÜ") for m in made)


def test_what_is_no_value_stays():
    for text in ("a::b and :: and std::x1", "at 12:30:45 or 10:20", "Mayor 5 2000x", "3 May", "Feb 30, 2001", "0999-01-01 and 3000-01-01", "٤٩ +٤٩ ٣٠ ١٢٣٤٥٦٧ ٢٠٢٤-٠١-٠١", "200 300 40000", "2.5.2020", "1.212.555.01878"):
        assert NAMES.text(text) == (text, []), text


def independent(value, size, key, tweak, valid):
    """The permutation as its description has it, written again: eight rounds on two halves, walked until valid."""
    import hashlib

    half = (max(2, (size - 1).bit_length()) + 1) // 2
    key = hashlib.blake2b(key, digest_size=32).digest()

    def f(k, x):
        wide = -(-half // 8)
        stream = b""
        while len(stream) < wide:
            stream += hashlib.blake2b(f"{k},{len(stream) // 64};".encode() + x.to_bytes(wide, "big"), key=key, digest_size=64, person=tweak).digest()
        return int.from_bytes(stream[:wide], "big") % 2**half

    while True:
        left, right = divmod(value, 2**half)
        for k in range(8):
            left, right = right, left ^ f(k, right)
        value = left * 2**half + right
        if value < size and valid(value):
            return value


def test_values_against_an_independent_version():
    """Cards, dates, numbers and addresses of a text, each found by splitting at '|' and permuted by the function above."""
    import ipaddress

    def luhn(n):
        digits = [int(c) for c in f"{n:016d}"]
        return (sum(digits[1::2]) + sum(sum(map(int, str(2 * d))) for d in digits[::2])) % 10 == 0

    def card(text):
        return f"{independent(int(text), 10**16, b'test key', b'card', luhn):016d}"

    def date(text):
        first, last = datetime.date(1000, 1, 1).toordinal(), datetime.date(2999, 12, 31).toordinal()
        kind = lambda d: (1900 <= d.year <= 2099, d.day > 12)
        day = datetime.date.fromisoformat(text)
        same = lambda v: kind(datetime.date.fromordinal(first + v)) == kind(day)
        return datetime.date.fromordinal(first + independent(day.toordinal() - first, last - first + 1, b"test key", b"date", same)).isoformat()

    def address(text):
        return str(ipaddress.IPv4Address(independent(int(ipaddress.IPv4Address(text)), 2**32, b"test key", b"ip", lambda _: True)))

    def ssn(text):
        ok = lambda v: not (f"{v:09d}"[:3] in ("000", "666") or v >= 9 * 10**8 or v // 10000 % 100 == 0 or v % 10000 == 0)
        out = f"{independent(int(text.replace('-', '')), 10**9, b'test key', b'ssn', ok):09d}"
        return f"{out[:3]}-{out[3:5]}-{out[5:]}"

    def number(text):
        ok = lambda v: f"{v:010d}"[0] > "1" and f"{v:010d}"[3] > "1"
        out = f"{independent(int(text.replace('-', '')), 10**10, b'test key', b'phone', ok):010d}"
        return f"{out[:3]}-{out[3:6]}-{out[6:]}"

    parts = [("4111111111111111", card), ("2024-02-29", date), ("1850-01-01", date), ("192.168.0.1", address), ("123-45-6789", ssn), ("212-555-0187", number), ("5500000000000004", card), ("2000-07-31", date)]
    text = " | ".join(v for v, _ in parts)
    assert NAMES.text(text)[0] == " | ".join(f(v) for v, f in parts)


def test_neighbours_and_case():
    text = '+1 (826) 555-4081 190.137.223.204, TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'
    made, spans = NAMES.text(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]
    assert made.split('"')[1].isupper() or made.split('"')[1].isdigit()


def test_odd_tables(spark):
    rows = pii_feistel.pseudonymise(odd_docs(spark), b"k").collect()
    assert sorted((str(r.doc_id), r.text or "", r.n_private) for r in rows) == sorted((str(d), t or "", 0) for d, t, *_ in ODD)
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert pii_feistel.pseudonymise(empty_docs(spark), b"k").count() == 0
    assert same_columns(pii_feistel.pseudonymise(clashing(odd_docs(spark)), b"k"), [c for c in CLASHING if c != "spans"])
    with pytest.raises(ValueError):
        pii_feistel.pseudonymise(odd_docs(spark), b"").count()


@needs_data
def test_query(spark):
    from tessella.llm.queries import DEMO_KEY

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    names = pii_feistel.Pseudonyms(DEMO_KEY)
    rows = op3_pii_feistel(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        made, spans = (None, []) if texts[r.doc_id] is None else names.text(texts[r.doc_id])
        assert (r.text, r.n_private) == (made, len(spans))
    assert sum(r.n_private for r in rows) > 5
