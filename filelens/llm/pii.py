"""Personal numbers replaced by pseudonyms of the same format.

Card, account, social security, telephone and network numbers, dates and addresses of
mail are found, validated (check digits, ranges, calendar) and permuted within their
own format by a keyed Feistel network: what is valid stays valid, and equal values
have equal pseudonyms in all documents, so they stay linked without being readable.
Numbers that only look alike (a wrong check digit, day 32) are left alone. Card and
account numbers are found beside other groups (expiry date, security code, next word);
only where a pseudonym would make such a neighbourhood valid it is another one.

Rows: null texts stay null, empty ones empty; repeated rows get a row each; a null id
is kept; other columns are kept by ``pseudonymise``.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filelens.llm import text as tx

# Replace in production: whoever has the key can link and undo pseudonyms.
KEY = b"for tests and examples only"
ROUNDS = 8
MEMO = 200_000
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

KINDS = ("mail", "iban", "card", "phone", "ssn", "date", "ip")
PATTERN = re.compile(
    r"(?P<mail>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?<![\w.])(?:"
    r"(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[.-]\d{4})(?!\w)"
    r"|(?P<phone2>\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?!\w)"
    r")|(?P<phone3>(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[.-]\d{4}(?!\w))"
    r"|(?P<phone4>(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
)
MAYBE = re.compile(r"[\d@]")
# Numbers in groups, with whatever groups stand beside them; which part it is is found by
# trying spans of groups. Card numbers may follow a dot that is no decimal point.
RUNS = {
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9])+\b"),
    "card": re.compile(r"(?<!\w)(?<!\d\.)\d(?:[ -]?\d){12,}(?![\w-])"),
}
GROUP = re.compile(r"[A-Za-z0-9]+")
LONGEST = 68  # characters of a number and the signs between its groups
IBAN_START = re.compile(r"[A-Z]{2}\d{2}")
IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)  # in the order of trying
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


class Feistel:
    """A keyed permutation of 0 .. size-1 for each size and tweak."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, at: int, half: int, bits: int) -> int:
        data = tweak + bytes([at]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        wide = hashlib.blake2b(data, key=self.key, digest_size=max(8, bits // 8 + 8)).digest()
        return int.from_bytes(wide, "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: str, good: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The image of ``value``; walks on until it is in range and ``good`` (which
        ``value`` must be), so the good values are permuted among themselves."""
        bits = max((size - 1).bit_length(), 2)
        high, low = bits // 2, bits - bits // 2
        mark = f"{tweak}:{size}:".encode()
        while True:
            a, b = value >> low, value & ((1 << low) - 1)
            # Halves of high and low bits change in turn, each by the other.
            for at in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if at % 2:
                    b ^= self._round(mark, at, a, low)
                else:
                    a ^= self._round(mark, at, b, high)
            value = (a << low) | b
            if value < size and (good is None or good(value)):
                return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _filled(shape: str, fill: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(fill)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total


def is_card(text: str) -> bool:
    digits = _digits(text)
    return luhn(digits) and len(set(digits)) > 1


def card(text: str, network: Feistel, back: bool = False) -> str | None:
    if not is_card(text):
        return None
    digits = _digits(text)
    # The first digit (the network) stays, the last one follows from the others.
    body = digits[1:-1]
    new = digits[0] + str(network.permute(int(body), 10 ** len(body), "card" + digits[0], back=back)).zfill(len(body))
    return _filled(text, new + str(-_luhn_sum(new + "0") % 10))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return IBAN.fullmatch(plain) is not None and _iban_rest(plain[4:] + plain[:4]) == 1


def iban(text: str, network: Feistel, back: bool = False) -> str | None:
    plain = text.replace(" ", "")
    if not is_iban(text):
        return None
    body = _by_class(plain[4:], network, "iban" + plain[:2], back)
    check = f"{98 - _iban_rest(body + plain[:2] + '00'):02d}"
    rest = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(rest) for c in text)


def _by_class(text: str, network: Feistel, tweak: str, back: bool = False) -> str:
    """Letters and digits permuted together, each within its class."""
    classes = [next((k for k in (LOWER, UPPER, DIGITS) if c in k), None) for c in text]
    value, size = 0, 1
    for c, kind in zip(text, classes, strict=True):
        if kind:
            value, size = value * len(kind) + kind.index(c), size * len(kind)
    if size == 1:
        return text
    value = network.permute(value, size, tweak + "".join(str(len(k or "")) for k in classes), back=back)
    out = []
    for c, kind in zip(reversed(text), reversed(classes), strict=True):
        if kind:
            value, at = divmod(value, len(kind))
            c = kind[at]
        out.append(c)
    return "".join(reversed(out))


def mail(text: str, network: Feistel, back: bool = False) -> str | None:
    name, _, host = text.rpartition("@")
    return _by_class(name, network, "mail@" + host.lower(), back) + "@" + host


def phone(text: str, network: Feistel, back: bool = False) -> str | None:
    digits = _digits(text)
    country = _digits(text.split()[0]) if text.startswith("+") and " " in text else ("1" if text.startswith("+1") else "")
    country = country if len(country) <= 3 and digits.startswith(country) else ""
    body = digits[len(country) :]
    if not 7 <= len(body) <= 15:
        return None
    # Numbers of the North American plan stay in the plan, others outside it.
    plan = lambda n: len(body) == 10 and str(n).zfill(10)[0] > "1" and str(n).zfill(10)[3] > "1"
    inside = plan(int(body))
    new = network.permute(int(body), 10 ** len(body), "phone" + country, lambda n: plan(n) == inside, back)
    return _filled(text, country + str(new).zfill(len(body)))


def ssn(text: str, network: Feistel, back: bool = False) -> str | None:
    def valid(n: int) -> bool:
        area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    value = int(_digits(text))
    return _filled(text, f"{network.permute(value, 10**9, 'ssn', valid, back):09d}") if valid(value) else None


def ip(text: str, network: Feistel, back: bool = False) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, network.permute(value, 1 << 32, "ip", back=back).to_bytes(4, "big")))


def date(text: str, network: Feistel, back: bool = False) -> str | None:
    """Written year first, or day first unless only month first can be meant."""
    a, mark, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", text).groups()
    if len(a) == 4:
        order = "ymd"
    else:
        order = "mdy" if mark == "/" and int(b) > 12 else "dmy"
    given = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(int(given["y"]), int(given["m"]), int(given["d"]))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None

    def fits(n: int) -> bool:
        """Read again, the date must have the same order of parts and their widths."""
        new = datetime.date.fromordinal(FIRST_DAY + n)
        wide = all(len(given[k]) == 2 or (v < 10 and not given[k].startswith("0")) for k, v in (("d", new.day), ("m", new.month)))
        return wide and (order != "mdy" or new.day > 12)

    new = datetime.date.fromordinal(FIRST_DAY + network.permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, f"date{order}{len(given['d'])}{len(given['m'])}", fits, back))
    made = {"y": str(new.year), "m": str(new.month).zfill(len(given["m"])), "d": str(new.day).zfill(len(given["d"]))}
    return mark.join(made[k] for k in order)


_CHANGE = {"mail": mail, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "date": date, "ip": ip}


class Pseudonyms:
    def __init__(self, key: bytes = KEY, back: bool = False):
        self.network, self.back = Feistel(key), back
        self.memo: dict[tuple[str, str], str | None] = {}

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts = dict.fromkeys(KINDS, 0)
        if not text or not MAYBE.search(text):
            return text, counts

        taken: list[tuple[int, int, str, str]] = []
        for kind in (None, *RUNS):
            gaps = zip([0, *(t[1] for t in taken)], [*(t[0] for t in taken), len(text)], strict=True)
            taken += [t for start, end in list(gaps) for t in (self._single(text, start, end) if kind is None else self._grouped(kind, text, start, end))]
            taken.sort()
        out, end = [], 0
        for start, stop, kind, new in taken:
            counts[kind] += 1
            out += [text[end:start], new]
            end = stop
        return "".join([*out, text[end:]]), counts

    def _single(self, text: str, at: int, end: int) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of numbers of fixed form; behind the first
        character of a rejected one the search goes on."""
        while match := PATTERN.search(text, at, end):
            kind = match.lastgroup.rstrip("234")
            new, at = self._pseudonym(kind, match[0]), match.start() + 1
            if new is not None:
                at = match.end()
                yield *match.span(), kind, new

    def _grouped(self, kind: str, text: str, at: int, end: int) -> Iterator[tuple[int, int, str, str]]:
        """The same of numbers in groups: spans of groups, the likeliest length first. A
        pseudonym must not make a span valid that was tried before and failed, or it could
        not be undone; it walks on until it does not."""
        for run in RUNS[kind].finditer(text, at, end):
            valid, change = (is_card, card) if kind == "card" else (is_iban, iban)
            made, first = list(run[0]), run.start()
            busy, failed, taken = bytearray(len(made)), {}, []
            for start, stop in _spans(kind, run[0]):
                if busy.find(1, start, stop) >= 0:
                    continue
                if valid(run[0][start:stop]):
                    busy[start:stop] = b"\1" * (stop - start)
                    taken.append((start, stop, [(a, b) for a in range(start - LONGEST, stop) for b in failed.get(a, ()) if b > start]))
                else:
                    failed.setdefault(start, []).append(stop)
            # One after the other, and undone the other way round.
            for start, stop, near in reversed(taken) if self.back else taken:
                new = self._pseudonym(kind, "".join(made[start:stop]))
                made[start:stop] = new
                while any(valid("".join(made[a:b])) for a, b in near):
                    new = change(new, self.network, self.back)
                    made[start:stop] = new
                yield first + start, first + stop, kind, new

    def _pseudonym(self, kind: str, found: str) -> str | None:
        if (kind, found) not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[kind, found] = _CHANGE[kind](found, self.network, self.back)
        return self.memo[kind, found]


def _spans(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans of whole groups that have a length of the kind, in the order of trying."""
    groups = [m.span() for m in GROUP.finditer(text)]
    found = []
    for i, (first, _) in enumerate(groups):
        if kind == "iban" and not IBAN_START.match(text, first):
            continue
        long = 0
        for a, b in groups[i:]:
            long += b - a
            if long > 34:
                break
            if kind == "iban" and long >= 15:
                found.append((long != IBAN_LENGTHS.get(text[first : first + 2]), -long, first, b))
            elif kind == "card" and long in CARD_LENGTHS:
                found.append((False, CARD_LENGTHS.index(long), first, b))
    return [(a, b) for _, _, a, b in sorted(found)]


def _changed(docs: DataFrame, key: bytes, back: bool, counted: bool) -> DataFrame:
    names = [f"n_{k}" for k in KINDS]

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            made = [own.text(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in made], batch.schema.field(at).type)
            if counted:
                columns += [pa.array([c[k] for _, c in made], pa.int64()) for k in KINDS]
            yield pa.record_batch(columns, [*batch.schema.names, *(names if counted else [])])

    shape = StructType(list(docs.schema.fields))
    for name in names if counted else []:
        shape = shape.add(name, "long")
    return docs.mapInArrow(change, shape)


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """Documents with pseudonyms in ``text``; with ``back`` the original values."""
    return _changed(docs, key, back, False)


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_<kind>...) per row of ``docs``."""
    return _changed(docs.select(F.col("doc_id").cast("long"), "text"), key, False, True)
