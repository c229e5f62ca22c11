"""Format-preserving pseudonyms for personal numbers and dates.

A number or date that passes its validation (check digits, octets, the calendar)
is replaced by another of the same format, by a keyed permutation of all values
of that format.  Equal values get equal pseudonyms in every document and in every
spelling, different values different ones, no value itself; the holder of the key
can go back.  What fails validation stays as it is.  Where a longer reading fails,
the others at the same place and the rest behind it are tried.

Dates with a day up to 12 and later days are permuted apart, so that a date keeps
its reading: 04/07/2011 is read day first before and after, 07/14/2011 month
first.  Phones keep their country code, all further digits move together, with or
without separators.  Account numbers have their country's length; what follows
them is not part of them.  The way back is exact but for one case: where something
that looks like an account number with wrong check digits holds another valid
value, its replacement makes the check digits right once in 97 times.

Defined cases: very long texts are searched in one pass with bounded patterns; a missing text stays missing; empty texts and texts without a
valid value stay as they are, byte for byte; repeated rows are replaced alike;
all other columns are carried; ``n_replaced`` replaces a column of that name.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from tenfold.llm import common

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n - 1 for any n, without fixed points where n > 1.

    A balanced Feistel network over the next even number of bits, walked until
    the value falls below n again.  A value goes through the network, one fixed
    step further in the permuted order, and back, so none stays where it was.
    """

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(kind.encode(), key=key[:64], digest_size=32, salt=n.bit_length().to_bytes(8, "little")).digest()
        self.bytes = (self.half + 7) // 8
        self.step = 1 + self._digest(255, 0, 16) % (n - 1) if n > 1 else 0

    def _digest(self, i: int, value: int, size: int) -> int:
        out, block = b"", 0
        while len(out) < size:
            data = bytes([i, block & 255]) + value.to_bytes(self.bytes, "little")
            out += hashlib.blake2b(data, key=self.key, digest_size=min(64, size - len(out))).digest()
            block += 1
        return int.from_bytes(out, "little")

    def _forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(ROUNDS):
                a, b = b, a ^ (self._digest(i, b, self.bytes) & self.mask)
            x = a << self.half | b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                a, b = b ^ (self._digest(i, a, self.bytes) & self.mask), a
            x = a << self.half | b
            if x < self.n:
                return x

    def permute(self, x: int) -> int:
        return self._back((self._forward(x) + self.step) % self.n)

    def restore(self, x: int) -> int:
        return self._back((self._forward(x) - self.step) % self.n)


@lru_cache(maxsize=512)
def feistel(key: bytes, kind: str, n: int) -> Feistel:
    return Feistel(key, kind, n)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def _mod97(country_and_body: str) -> int:
    """Remainder of an account number whose country and check digits stand at its end."""
    return int("".join(str(int(c, 36)) for c in country_and_body)) % 97


def _respell(spelled: str, digits: str) -> str:
    """The digits of a spelling replaced in order; separators stay."""
    fresh = iter(digits)
    return re.sub(r"[0-9]", lambda m: next(fresh), spelled)


def _only_digits(spelled: str) -> str:
    return re.sub(r"[^0-9]", "", spelled)


def _move_digits(key: bytes, kind: str, digits: str, back: bool) -> str:
    f = feistel(key, f"{kind}{len(digits)}", 10 ** len(digits))
    return f"{(f.restore if back else f.permute)(int(digits)):0{len(digits)}d}"


def _card(key, spelled, back):
    digits = _only_digits(spelled)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = _move_digits(key, "card", digits[:-1], back)
    return _respell(spelled, body + _luhn_digit(body))


# ---- fixed values: length of an account number by country, two-digit calling codes ----
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
# ----------------------------------------------------------------------------------------


def _cuts(spelled: str) -> list[str]:
    """What may be the account number: the country's length; for other countries any whole groups, the most first."""
    length = ACCOUNT_LENGTHS.get(spelled[:2])
    ends = [i for i in range(len(spelled), 14, -1) if spelled[i - 1] != " " and (i == len(spelled) or spelled[i] == " ")]
    found = [(spelled[:i], i - spelled.count(" ", 0, i)) for i in ends]
    return [cut for cut, n in found if (n == length if length else 15 <= n <= 34)]


def _account(key, spelled, back):
    """The pseudonym of the account number that the spelling begins with, as long as that is."""
    for cut in _cuts(spelled):
        plain = cut.replace(" ", "")
        if _mod97(plain[4:] + plain[:4]) != 1 or not 2 <= int(plain[2:4]) <= 98:
            continue
        body = _respell(plain[4:], _move_digits(key, "account", _only_digits(plain[4:]), back)) if _only_digits(plain[4:]) else plain[4:]
        return _respell(cut, f"{98 - _mod97(body + plain[:2] + '00'):02d}" + _only_digits(body))
    return None


def _address(key, spelled, back):
    octets = [int(x) for x in spelled.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in spelled.split(".")):
        return None
    f = feistel(key, "ipv4", 1 << 32)
    x = (f.restore if back else f.permute)(int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def _insured(key, spelled, back):
    area, group, serial = spelled.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    a = int(area) - 1 - (int(area) > 666)
    f = feistel(key, "insured", 898 * 99 * 9999)
    x = (f.restore if back else f.permute)((a * 99 + int(group) - 1) * 9999 + int(serial) - 1)
    a, group, serial = x // (99 * 9999), x // 9999 % 99 + 1, x % 9999 + 1
    return f"{a + 1 + (a >= 665):03d}-{group:02d}-{serial:04d}"


def _phone(key, spelled, back):
    digits = _only_digits(spelled)
    code = 0
    if spelled[0] == "+":
        code = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    if digits[0] == "0" and code or not 6 <= len(digits) - code <= 14:
        return None
    return _respell(spelled, digits[:code] + _move_digits(key, "phone", digits[code:], back))


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()


@lru_cache(maxsize=2)
def _days(early: bool) -> list[int]:
    """All days of 1900 to 2099 up to the 12th of a month, or all others."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day <= 12) == early]


def _date(key, spelled, back):
    """Year first, or day first; where that is no date, month first."""
    separator = re.search(r"[^0-9]", spelled)[0]
    parts = spelled.split(separator)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        at = {k: int(v) for k, v in zip(order, parts, strict=True)}
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        early = at["d"] <= 12
        days = _days(early)
        f = feistel(key, "early" if early else "late", len(days))
        moved = datetime.date.fromordinal(days[(f.restore if back else f.permute)(bisect_left(days, day))])
        text = {"y": f"{moved.year:04d}", "m": f"{moved.month:02d}", "d": f"{moved.day:02d}"}
        return separator.join(text[k] for k in order)
    return None


def _mail(key, spelled, back):
    """Digits stay digits and letters letters in the local part; the domain stays."""
    local, domain = spelled.rsplit("@", 1)
    radix = [10 if c.isdigit() else 26 for c in local if c.isalnum()]
    x, n = 0, 1
    for c, r in zip((c for c in local.lower() if c.isalnum()), radix, strict=True):
        x, n = x * r + (int(c) if r == 10 else ord(c) - 97), n * r
    f = feistel(key, "mail" + "".join("0" if r == 10 else "a" for r in radix), n)
    x = (f.restore if back else f.permute)(x)
    fresh = []
    for r in reversed(radix):
        x, d = divmod(x, r)
        fresh.append(str(d) if r == 10 else chr(97 + d))
    out = []
    for c in local:
        out.append((fresh.pop().upper() if c.isupper() else fresh.pop()) if c.isalnum() else c)
    return "".join(out) + "@" + domain


KINDS = {
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _account),
    "ipv4": (r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])", _address),
    "date": (r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9])", _date),
    "insured": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _insured),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", _card),
    "phone": (
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
        r"|\+[0-9]{1,3}[ .-]?[0-9](?:[ .-][0-9]{2}){4}(?![0-9])"
        r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
        _phone,
    ),
}
EACH = {k: re.compile(p) for k, (p, _) in KINDS.items()}
NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")


@lru_cache(maxsize=100_000)
def pseudonym(key: bytes, kind: str, spelled: str, back: bool = False) -> str | None:
    """The pseudonym of one spelled value; None where it fails validation."""
    return (_mail if kind == "mail" else KINDS[kind][1])(key, spelled, back)


def _numbers(text: str, start: int, stop: int, key: bytes, back: bool, out: list[str]) -> int:
    """Append text[start:stop] to ``out`` with its numbers and dates replaced; how many were."""
    done, at, count = start, start, 0
    if not _DIGIT.search(text, start, stop):
        at = stop
    while m := NUMBERS.search(text, at, stop):
        at = m.start()
        for kind, pattern in EACH.items():
            hit = pattern.match(text, at, stop)
            made = hit and pseudonym(key, kind, hit[0], back)
            if made:
                out += [text[done:at], made]
                done = at = at + (len(made) if kind == "account" else len(hit[0]))
                count += 1
                break
        else:
            at += 1
    out.append(text[done:stop])
    return count


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with every valid value replaced, and their number."""
    out, count, done = [], 0, 0
    mails = [m.span() for m in MAIL.finditer(text)] if "@" in text else []
    for start, stop in mails:
        count += 1 + _numbers(text, done, start, key, back, out)
        out.append(pseudonym(key, "mail", text[start:stop], back))
        done = stop
    count += _numbers(text, done, len(text), key, back, out)
    return "".join(out), count


def _replace(batches, key: bytes, column: str):
    for batch in batches:
        texts, counts = [], []
        for t in batch.column(column).to_pylist():
            made, n = replace(t, key) if t else (t, 0)
            texts.append(made)
            counts.append(n)
        arrays = [pa.array(texts, batch.schema.field(n).type) if n == column else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], [*batch.schema.names, "n_replaced"])


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All documents with pseudonyms in their text, and ``n_replaced``.  No row moves."""
    docs = docs.drop("n_replaced")
    schema = StructType([*docs.schema.fields, StructField("n_replaced", LongType())])
    return common.map_arrow(docs, partial(_replace, key=key, column=text), schema)
