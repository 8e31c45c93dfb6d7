"""Personal data and secrets replaced by format-preserving pseudonyms.

A pattern proposes, a check decides (Luhn, mod 97, octets, calendar, number plan), and what passes is permuted by a
keyed Feistel network within its own format: card numbers stay valid card numbers of the same length and grouping,
dates stay dates in the same notation, addresses stay addresses. The permutation depends on the key and the kind only,
so equal values get equal pseudonyms in every document, and whoever has the key can go back. A cycle-walk keeps the result inside
the format where the network's domain is larger. Dates are permuted as days, so one day stays one day in all notations;
days of 1900 to 2099 stay among themselves, and so do the others of the years 1 to 9999. Phone numbers keep their country
code, and what follows it is permuted as the same number is without one, so notations of a number stay linked.

One narrow stage: each row alone, memory of one Arrow batch, time linear in a text however long its values are. Null
stays null; empty stays empty; texts without a digit,
sign or key prefix that some kind needs are passed on unread. Null ids, ties and repeated rows change nothing. An empty table gives an empty
result. Extra columns pass through ``pseudonymise``; its own one is named ``pii``, with _ behind it if there is such a one.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, passed, restored, slim, small_batches

ROUNDS = 8
#: Symbols permuted as one number: its half must fit the 64 bytes of a round.
CHUNK = 190
#: For tests and the query; in production pass a secret one.
KEY = b"a key for tests only"
FIRST_DAY, LAST_DAY, ALL_DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal(), datetime.date.max.toordinal()
#: Country codes of two digits. 1 and 7 have one; all others have three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked until it is inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(r: int, x: int) -> int:
        raw = hashlib.blake2b(x.to_bytes((half + 7) // 8, "big"), key=key[:64], person=r.to_bytes(2, "big") + hashlib.blake2b(tweak + size.to_bytes((size.bit_length() + 7) // 8, "big"), digest_size=14).digest(), digest_size=min(64, (half + 7) // 8 + 1)).digest()
        return int.from_bytes(raw, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        value = (left << half) | right
        if value < size:
            return value


class Cipher:
    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def number(self, value: int, size: int, kind: str) -> int:
        return permute(value, size, self.key, kind.encode(), self.back)

    def digits(self, s: str, kind: str) -> str:
        return str(self.number(int(s), 10 ** len(s), kind)).zfill(len(s)) if s else s

    def symbols(self, s: str, alphabet: str, kind: str) -> str:
        """s as a number to the base of its alphabet, ``CHUNK`` symbols at a time."""
        if not s:
            return s
        if len(s) > CHUNK:
            return "".join(self.symbols(s[i : i + CHUNK], alphabet, f"{kind}{i or ''}") for i in range(0, len(s), CHUNK))
        n, v = len(alphabet), 0
        for c in s:
            v = v * n + alphabet.index(c)
        v = self.number(v, n ** len(s), kind)
        out = []
        for _ in s:
            v, r = divmod(v, n)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def like(self, s: str, kind: str) -> str:
        """Digits, lower and upper case letters each permuted among their places; all else stays."""
        out = list(s)
        for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            at = [i for i, c in enumerate(s) if c in alphabet]
            for i, c in zip(at, self.symbols("".join(s[i] for i in at), alphabet, kind), strict=True):
                out[i] = c
        return "".join(out)


def fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def card(s: str, c: Cipher) -> str | None:
    d = only_digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] or len(set(d)) < 2:
        return None
    body = c.digits(d[:-1], "card")
    return fill(s, body + luhn(body))


def phone(s: str, c: Cipher) -> str | None:
    d = only_digits(s)
    if not 8 <= len(d) <= 15:
        return None
    code = d[: 1 if d[0] in "17" else 2 if d[:2] in TWO_DIGIT_CODES else 3] if s[0] == "+" else ""
    return fill(s, code + c.digits(d[len(code) :], "phone"))


def ipv4(s: str, c: Cipher) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = c.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


def ssn(s: str, c: Cipher) -> str | None:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    area = a - 1 - (a > 666)
    v = c.number((area * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999, "ssn")
    v, n = divmod(v, 9999)
    area, g = divmod(v, 99)
    area += 1
    return f"{area + (area >= 666):03}-{g + 1:02}-{n + 1:04}"


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(x, 36)) for x in account + country + '00')) % 97:02}"


#: Country and length of its account numbers.
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def iban_ends(s: str) -> list[int]:
    """Where the number may end, as words behind it can look like parts of it: by its country, or else at each word's end, longest first."""
    ends = [i for i in range(len(s), 0, -1) if i == len(s) or s[i] == " "]
    n = _IBAN_LENGTHS.get(s[:2])
    # No word ends at the country's length: the whole match, as for other countries.
    return [i for i in ends if n and i - s.count(" ", 0, i) == n] or ends[: 1 if n else None]


def iban(s: str, c: Cipher) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    account = c.like(plain[4:], "iban" + plain[:2])
    it = iter(plain[:2] + _iban_check(plain[:2], account) + account)
    return "".join(x if x == " " else next(it) for x in s)


_DATES = ((re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})"), (1, 3, 4)), (re.compile(r"(\d{2})([-/.])(\d{2})\2(\d{4})"), (4, 3, 1)))


def another_day(day: int, c: Cipher) -> int:
    """By ordinal: a day of 1900 to 2099 for one of these, another one for any other."""
    modern = LAST_DAY - FIRST_DAY + 1
    if FIRST_DAY <= day <= LAST_DAY:
        return FIRST_DAY + c.number(day - FIRST_DAY, modern, "date")
    n = c.number(day - 1 if day < FIRST_DAY else day - 1 - modern, ALL_DAYS - modern, "date")
    return n + 1 if n + 1 < FIRST_DAY else n + 1 + modern


def date(s: str, c: Cipher) -> str | None:
    """Year first, or day, month, year; month, day, year where only that is a date. Short years and days stay as they are."""
    for pattern, order in _DATES:
        m = pattern.fullmatch(s)
        if not m:
            continue
        for y, mo, d in (order, (order[0], order[2], order[1])) if order[0] == 4 else (order,):
            try:
                day = datetime.date(int(m[y]), int(m[mo]), int(m[d])).toordinal()
            except ValueError:
                continue
            # Day-first and month-first notations differ only where the day exceeds 12: days up to 12 and beyond stay apart.
            new = datetime.date.fromordinal(day)
            small = new.day <= 12
            while True:
                new = datetime.date.fromordinal(another_day(new.toordinal(), c))
                if (new.day <= 12) == small:
                    break
            part = {y: f"{new.year:04}", mo: f"{new.month:02}", d: f"{new.day:02}", 2: m[2]}
            sep = m[2]
            return sep.join(part[i] for i in (1, 3, 4))
    return None


def email(s: str, c: Cipher) -> str | None:
    name, _, host = s.rpartition("@")
    labels = host.split(".")
    if any(not x or x[0] == "-" or x[-1] == "-" for x in labels) or name[0] == "." or name[-1] == "." or ".." in name:
        return None
    return f"{c.like(name, 'email')}@{'.'.join([c.like('.'.join(labels[:-1]), 'host'), labels[-1]])}"


def access_key(s: str, c: Cipher) -> str | None:
    return s[:4] + c.symbols(s[4:], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "access_key")


def secret(s: str, c: Cipher) -> str | None:
    start = re.match(r"[^=:]*[=:][ ]*[\"']?", s).end()
    value = s[start:].rstrip("\"',;:?)]}>")
    if not re.search(r"[0-9A-Za-z]", value):
        return None
    hexed = re.fullmatch(r"[0-9a-f]+", value)
    new = c.symbols(value, "0123456789abcdef", "secret") if hexed else c.like(value, "secret")
    return s[:start] + new + s[start + len(value) :]


#: A secret's whole value: up to the closing quote (or white space, if none closes on the line); bare, up to white space.
_VALUE = r"""(?:"(?:[^"\\\n]|\\.){8,}+"|'(?:[^'\\\n]|\\.){8,}+'|"[^\s"]{8,}+|'[^\s']{8,}+|(?=[^\s"']\S{6,}[^\s"',;:?)\]}>])\S++)"""
#: Kind -> (pattern, check and permutation). The first that matches at a place is tried.
KINDS: dict[str, tuple[str, Callable[[str, Cipher], str | None]]] = {
    "secret": (r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b)[ ]{0,2}[=:][ ]{0,2}" + _VALUE, secret),
    "access_key": (r"\bA[KS]IA[0-9A-Z]{16}\b", access_key),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+\b", email),
    "iban": (r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b", iban),
    "date": (r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?:(?=T\d)|(?![\w/-]|\.\d))", date),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ipv4),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", phone),
    "card": (r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])", card),
}
_HINT = re.compile(r"[0-9@=:]|A[KS]IA")


def _pattern() -> re.Pattern:
    parts, groups = [], 0
    for kind, (p, _) in KINDS.items():
        base = groups + 1
        p = re.sub(r"\\([12])", lambda m, base=base: f"\\{base + int(m[1])}", p)
        parts.append(f"(?P<{kind}>{p})")
        groups = re.compile("|".join(parts)).groups
    return re.compile("|".join(parts))


_FIND = _pattern()


def replace(text: str, c: Cipher) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) in the old text of each."""
    if not _HINT.search(text):
        return text, []
    out, found, done, at = [], [], 0, 0
    while m := _FIND.search(text, at):
        kind = m.lastgroup
        new, end = None, m.end()
        for n in iban_ends(m[0]) if kind == "iban" else [len(m[0])]:
            new, end = KINDS[kind][1](m[0][:n], c), m.start() + n
            if new is not None:
                break
        if new is None:
            at = m.start() + 1
            while at < m.end() and text[at - 1].isalnum() and text[at].isalnum():
                at += 1  # not into the middle of a word or number
            continue
        out += [text[done : m.start()], new]
        found.append((kind, m.start(), end))
        done = at = end
    return "".join([*out, text[done:]]), found


def _mapped(key: bytes, back: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cipher(key, back)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [(None, []) if t is None else replace(t, c) for t in b.column("text").to_pylist()]
            rest = [n for n in b.schema.names if n != "text"]
            found = pa.array([[dict(zip(("kind", "start", "end"), f, strict=True)) for f in r[1]] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array([r[0] for r in rows], pa.string()), found], names=[*rest, "text", "pii"])

    return over


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` (``back``: with the values again), and ``pii`` (or that with _ behind it): kind, start, end of each in the old text."""
    small_batches(docs.sparkSession)
    d, name = slim(docs), free_name("pii", docs.columns)
    out = d.select("doc_id", "_rest", "text").mapInArrow(_mapped(key, back), passed(d.schema, "doc_id", "_rest", "text") + ", pii array<struct<kind:string,start:int,end:int>>")
    return restored(out.withColumnRenamed("pii", name), docs.columns, extra=(name,))


def pseudonym_rows(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text, n_found, kinds (sorted, comma-joined, each once)."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"))
