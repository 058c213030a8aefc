"""Format-preserving pseudonyms for personal data and secrets, by keyed Feistel networks.

A found value is validated (check digits, calendar, ranges) and mapped to a number below the size of its
format: all digits of a card but the first and the check digit, the days of two centuries, the letters and
digits of a name by position. A Feistel network P, keyed and tagged by the kind and format, permutes these
numbers, and the pseudonym is P^-1(P(x) + s) with s coprime to the size. That is one cycle over the whole
format, so no value stands for itself, and walking on until a valid value comes up is a permutation of the
valid ones. Equal values get equal pseudonyms in all documents, whatever separators they are written with;
values that fail validation stay as they are. Everything is per row, so no data moves between machines.

Null text stays null, with no findings. Texts are searched as a whole, whatever their length. Overlapping
findings go to the one that begins first, then to the kind named first. Repeated rows give equal results, an
empty table an empty one. A column called ``pii`` in the input gives way to the result's.
"""

from __future__ import annotations

import datetime
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from tallyroll.llm.common import slices

ROUNDS = 10
DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() + 1)
HINT = regex.compile("[0-9@=:]")

# What each kind of value looks like before it is validated.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:(?i:password|passwd|pwd|token|secret|api_?key))\s{0,3}[=:]\s{0,3}[\"']?(?<body>[A-Za-z0-9_+/-]{8,}+))",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?<sep>[./])[0-9]{2}(?P=sep)[0-9]{4})(?![./-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}(?<gap>[-. ])[0-9]{3}(?P=gap)[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
FOUND = regex.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))


class Cycle:
    """A keyed permutation of 0 .. size - 1 that is one cycle."""

    def __init__(self, key: bytes, tag: str, size: int):
        self.size, self.side = size, math.isqrt(size - 1) + 1 if size > 1 else 1
        self.key = hashlib.blake2b(tag.encode(), key=key, digest_size=32).digest()
        self.step = 1 + self._hash(ROUNDS, size) % max(1, size - 1)
        while math.gcd(self.step, size) != 1:
            self.step += 1

    def _hash(self, turn: int, value: int) -> int:
        data = value.to_bytes((value.bit_length() + 7) // 8 or 1, "little")
        size = min(64, (self.size.bit_length() + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, salt=bytes([turn]), digest_size=size).digest(), "little")

    def _feistel(self, x: int, back: bool) -> int:
        while True:
            left, right = divmod(x, self.side)
            if back:
                for turn in reversed(range(ROUNDS)):
                    left, right = (right - self._hash(turn, left)) % self.side, left
            else:
                for turn in range(ROUNDS):
                    left, right = right, (left + self._hash(turn, right)) % self.side
            x = left * self.side + right
            if x < self.size:
                return x

    def next(self, x: int) -> int:
        return self._feistel((self._feistel(x, False) + self.step) % self.size, True)

    def previous(self, x: int) -> int:
        return self._feistel((self._feistel(x, False) - self.step) % self.size, True)


@lru_cache(maxsize=4096)
def cycle(key: bytes, tag: str, size: int) -> Cycle:
    return Cycle(key, tag, size)


# A format is (tag, size, value, from value to text, which values are valid).
Format = tuple[str, int, int, Callable[[int], str], Callable[[int], bool]]


def always(_: int) -> bool:
    return True


def by_position(kind: str, text: str) -> Format:
    """Letters and digits vary within their class; all other characters stay."""
    radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    value = 0
    for c, r in zip(text, radix):
        value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0)

    def show(x: int) -> str:
        out = []
        for c, r in zip(reversed(text), reversed(radix)):
            x, y = divmod(x, r)
            out.append(str(y) if r == 10 else chr(y + (65 if c.isupper() else 97)) if r == 26 else c)
        return "".join(reversed(out))

    shape = "".join("9" if r == 10 else c if r == 1 else "A" if c.isupper() else "a" for c, r in zip(text, radix))
    return f"{kind}:{shape}", math.prod(radix), value, show, always


def refill(text: str, digits: str) -> str:
    """Put new digits where the old ones stand."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def card(text: str) -> Format | None:
    d = regex.sub("[^0-9]", "", text)
    if d[0] not in "23456" or luhn(d[:-1]) != int(d[-1]):
        return None
    n = len(d) - 2

    def show(x: int) -> str:
        body = d[0] + str(x).zfill(n)
        return refill(text, body + str(luhn(body)))

    return f"card:{d[0]}:{n}", 10**n, int(d[1:-1]), show, always


def ssn(text: str) -> Format | None:
    def valid(x: int) -> bool:
        s = str(x).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    x = int(text.replace("-", ""))
    return ("ssn", 10**9, x, lambda y: refill(text, str(y).zfill(9)), valid) if valid(x) else None


def phone(text: str) -> Format | None:
    d = regex.sub("[^0-9]", "", text)
    plus = text.startswith("+")
    if plus and not (d[0] == "1" and len(d) == 11):
        head, body = d[:2], d[2:]
        return f"phone:{head}:{len(body)}", 10 ** len(body), int(body), lambda y: refill(text, head + str(y).zfill(len(body))), always
    head, body = d[:-10], d[-10:]

    def valid(x: int) -> bool:
        s = str(x).zfill(10)
        return s[0] in "23456789" and s[3] in "23456789"

    if not plus and not valid(int(body)):
        return None
    same = valid(int(body))
    return f"phone:us:{same}", 10**10, int(body), lambda y: refill(text, head + str(y).zfill(10)), lambda y: valid(y) == same


def ip(text: str) -> Format | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    show = lambda y: ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    return "ip", 1 << 32, sum(int(p) << s for p, s in zip(parts, (24, 16, 8, 0))), show, always


def date_order(text: str) -> str | None:
    """The strptime pattern of a date; with day and month in doubt the day comes first."""
    orders = ["%Y-%m-%d"] if text[4] == "-" else ["%d{0}%m{0}%Y", "%m{0}%d{0}%Y"]
    for order in orders:
        order = order.format(text[2])
        try:
            day = datetime.datetime.strptime(text, order).toordinal()
        except ValueError:
            continue
        return order if DAYS[0] <= day < DAYS[1] else None
    return None


def date(text: str) -> Format | None:
    order = date_order(text)
    if not order:
        return None
    show = lambda y: datetime.date.fromordinal(DAYS[0] + y).strftime(order)
    x = datetime.datetime.strptime(text, order).toordinal() - DAYS[0]
    month_first = order.startswith("%m")
    tag = "date:month first" if month_first else "date"
    return tag, DAYS[1] - DAYS[0], x, show, (lambda y: date_order(show(y)) == order) if month_first else always


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def iban(text: str) -> Format | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
        return None
    tag, size, x, show_body, valid = by_position("iban:" + plain[:2], plain[4:])

    def show(y: int) -> str:
        body = show_body(y)
        check = 98 - iban_number(plain[:2] + "00" + body) % 97
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    return tag, size, x, show, valid


VALIDATED = {"card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date, "iban": iban}


@lru_cache(maxsize=20_000)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """What stands for a value, or null where it is not valid."""
    if kind == "email":
        local, at, host = text.partition("@")
        inner = pseudonym("name", local, key)
        return None if inner is None else inner + at + host
    if kind == "secret" and text.startswith("AKIA"):
        return "AKIA" + pseudonym("name", text[4:], key)
    made = VALIDATED[kind](text) if kind in VALIDATED else by_position(kind, text)
    if made is None:
        return None
    tag, size, x, show, valid = made
    if size < 2:
        return None
    walk = cycle(key, tag, size)
    y = walk.next(x)
    while not valid(y):
        y = walk.next(y)
    return show(y)


def masked(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and (kind, start, length) of each value in the original."""
    if not text or not HINT.search(text):
        return text, []
    out, spans, at, begin = [], [], 0, 0
    while match := FOUND.search(text, begin):
        kind, start, end = match.lastgroup, match.start(), match.end()
        kind = next(k for k in PATTERNS if match.group(k) is not None)
        if kind == "secret" and match.group("body"):
            start = match.start("body")
        new = pseudonym(kind, text[start:end], key)
        if new is None:
            # Another kind may still fit here or a little later.
            found = next((m for k in PATTERNS if k != kind and (m := SINGLE[k].match(text, match.start())) and pseudonym(k, m.group(), key)), None) if kind != "secret" else None
            if found is None:
                begin = match.start() + 1
                continue
            kind, end = next(k for k in PATTERNS if SINGLE[k] is found.re), found.end()
            new = pseudonym(kind, found.group(), key)
        out += [text[at:start], new]
        spans.append({"kind": kind, "start": start, "length": end - start})
        at = begin = end
    return "".join([*out, text[at:]]), spans


SINGLE = {kind: regex.compile(pattern) for kind, pattern in PATTERNS.items()}


def with_pseudonyms(df: DataFrame, key: bytes, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all), ``text`` with pseudonyms, and ``pii``: kind, start and length of each value."""
    columns = [c for c in (df.columns if keep is None else keep) if c != "pii"]
    place = columns.index(text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    kept = df.select(*[df[f"`{c}`"].cast("string").alias(c) if c == text else df[f"`{c}`"] for c in columns])
    schema = T.StructType([*kept.schema.fields, T.StructField("pii", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            done = [masked(t, key) for t in part.column(place).to_pylist()]
            new = [*part.columns, pa.array([s for _, s in done], spans)]
            new[place] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays(new, names=schema.names)

    return kept.mapInArrow(work, schema)
