"""Format-preserving pseudonyms for personal data.

Validated numbers and dates (payment cards by Luhn, phone numbers, social security numbers, IPv4
addresses, IBANs by their remainder, calendar dates), email addresses and access keys are found by
pattern and check (values of access keys at any length, up to dots that end them), and replaced by a keyed permutation of their own format: a Feistel network on a
mixed-radix domain with cycle walking, so equal values get equal pseudonyms in every document, and
different values stay different. Layout (separators, letter case, length) stays as it is, and plays no part
in the permutation: a number, date or address gets the same pseudonym in any of its layouts. The key is
the caller's.

Cards, IBANs and international numbers can stand beside other digits or capital words: every length that
their pattern admits is tried at every start. Of valid spans that overlap, those of a card brand's or
a country's own length come first, then the longer, then the earlier ones. Finds of earlier kinds are never part of a later one's.

Defined cases: a null text stays null with no finds; an empty text stays empty; repeated rows give
equal rows; an empty table gives an empty result; texts are scanned whole; columns called n_pii or
pii_kinds are replaced, all others are kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidied

#: The key of the registered query alone, which has to give the same result in every run.
QUERY_KEY = "pseudonym-key-1"
#: Texts of a batch that are Python's at a time.
TOGETHER = 256
ROUNDS = 8


def _round(key: bytes, r: int, x: int, kind: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}|{r}|{x}".encode(), key=key, digest_size=16).digest(), "big")


def permuted(x: int, size: int, kind: str, key: bytes) -> int:
    """The image of x under a keyed permutation of range(size).

    Unbalanced Feistel rounds over a*b >= size; values outside the domain are walked on."""
    a = max(2, isqrt(size - 1) + 1)
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in range(0, ROUNDS, 2):
            left = (left + _round(key, r, right, kind)) % a
            right = (right + _round(key, r + 1, left, kind)) % b
        x = left * b + right
        if x < size:
            return x


def luhn_ok(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _relaid(found: str, digits: str) -> str:
    """found with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in found)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _walk(d: str, kind: str, key: bytes, good: Callable[[str], bool]) -> str:
    """Permutes a digit string, walking on until good() holds again."""
    x, n = int(d), 10 ** len(d)
    while True:
        x = permuted(x, n, f"{kind}{len(d)}", key)
        if good(out := str(x).zfill(len(d))):
            return out


#: First digits and lengths of the common card brands.
BRANDS = re.compile(r"4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6[0-9]{15,18}")


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and d[0] in "23456" and len(set(d)) > 1 and luhn_ok(d)


def _card(s: str, key: bytes) -> str | None:
    if not _card_ok(s):
        return None
    d = _digits(s)
    body = _walk(d[:-1], "card", key, lambda x: x[0] == d[0])
    return _relaid(s, next(body + c for c in "0123456789" if luhn_ok(body + c)))


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)
    head, d = (d[0], d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)
    if len(d) != 10 or d[0] in "01":
        return None
    return _relaid(s, head + _walk(d, "phone", key, lambda x: x[0] not in "01"))


def _intl_ok(s: str) -> bool:
    d = _digits(s)
    return 9 <= len(d) <= 15 and d[0] != "0"


def _intl(s: str, key: bytes) -> str | None:
    if not _intl_ok(s):
        return None
    d = _digits(s)
    if len(d) == 11 and d[0] == "1" and d[1] not in "01":
        return _phone(s, key)
    return _relaid(s, d[:2] + _walk(d[2:], "intl" + d[:2], key, lambda x: True))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(s: str, key: bytes) -> str | None:
    d = _digits(s)
    return _relaid(s, _walk(d, "ssn", key, _ssn_ok)) if _ssn_ok(d) else None


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    x = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ip", key)
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Dates are permuted among the days of these years.
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _day(y: str, m: str, d: str) -> int | None:
    try:
        n = dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return n if FIRST <= n <= LAST else None


def _date(s: str, key: bytes) -> str | None:
    """Year, day or month first; month first only where the day can't be a month.

    Days that can be months and others are permuted apart, so that a layout says the same before and after."""
    year_first = s[4] in "-/."
    a, b, c = (s[:4], s[5:7], s[8:]) if year_first else (s[6:], s[3:5], s[:2])
    layout, n = ("%Y%m%d" if year_first else "%d%m%Y"), _day(a, b, c)
    if n is None and not year_first:
        layout, n = "%m%d%Y", _day(a, c, b)
    if n is None:
        return None
    late = dt.date.fromordinal(n).day > 12
    while True:
        n = FIRST + permuted(n - FIRST, LAST - FIRST + 1, "date", key)
        new = dt.date.fromordinal(n)
        if (new.day > 12) == late:
            return _relaid(s, new.strftime(layout))


#: Lengths of IBANs by country.
COUNTRIES = frozenset(
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 "
    "PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
)


def _number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _iban_ok(s: str) -> bool:
    d = s.replace(" ", "")
    return 15 <= len(d) <= 34 and _number(d[4:] + d[:4]) % 97 == 1


def _iban(s: str, key: bytes) -> str | None:
    if not _iban_ok(s):
        return None
    d = s.replace(" ", "")
    body = _letters(d[4:], "iban", key)
    check = 98 - _number(body + d[:2] + "00") % 97
    it = iter(f"{d[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


#: Alphabets that are permuted within themselves.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


#: Characters that are permuted at a time: half their domain has to lie well within the 128 bits of a round, else places stay in clear.
WIDTH = 40


def _letters(s: str, kind: str, key: bytes) -> str:
    """Permutes s among all strings with the same class of character at every place.

    A longer string is permuted block by block, each under a name of what stands before it."""
    out, before = [_block(s[:WIDTH], kind, key)], hashlib.blake2b(key=key, digest_size=16)
    for at in range(WIDTH, len(s), WIDTH):
        before.update(s[at - WIDTH : at].encode())
        out.append(_block(s[at : at + WIDTH], f"{kind}:{before.hexdigest()}", key))
    return "".join(out)


def _block(s: str, kind: str, key: bytes) -> str:
    places = [next((k for k in CLASSES if c in k), None) for c in s]
    size, x = 1, 0
    for c, k in zip(s, places):
        if k:
            size, x = size * len(k), x * len(k) + k.index(c)
    if size == 1:
        return s
    shape = "".join("-" if k is None else str(CLASSES.index(k)) for k in places)
    x, out = permuted(x, size, f"{kind}:{shape}", key), []
    for c, k in zip(reversed(s), reversed(places)):
        if k:
            x, i = divmod(x, len(k))
            out.append(k[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.lower().rpartition("@")
    host, dot, top = domain.partition(".")
    new = f"{_letters(local, 'email', key)}@{_letters(host, 'host', key)}{dot}{top}"
    return "".join(b.upper() if a.isupper() else b for a, b in zip(s, new))


def _secret(s: str, key: bytes) -> str | None:
    return s[:4] + _letters(s[4:], "secret", key)


def _assigned(s: str, key: bytes) -> str | None:
    value = re.search(r"[A-Za-z0-9/+_.-]+$", s)[0]
    return s[: -len(value)] + _letters(value, "assigned", key)


#: (kind, pattern, pseudonym or None if the find doesn't hold); earlier kinds win where finds overlap.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", _email),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|(?<![A-Za-z0-9])sk-[A-Za-z0-9]{32,}(?![A-Za-z0-9])", _secret),
    ("secret", r"(?<![A-Za-z0-9])(?:[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss][_-]?[Tt][Oo][Kk][Ee][Nn]|[Tt][Oo][Kk][Ee][Nn]) ?[=:] ?[\"']?(?=[A-Za-z/+_.-]*[0-9])[A-Za-z0-9/+_-][A-Za-z0-9/+_.-]{6,}[A-Za-z0-9/+_-]", _assigned),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("date", r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])", _date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    ("phone", r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", _phone),
    ("intl", r"(?<![0-9+])\+[1-9][0-9](?:[ -]?[0-9]){7,13}(?![0-9])", _intl),
)
#: Kinds whose pattern admits several lengths: what may not follow one, whether it holds, and whether it is of a known length.
LENGTHS: dict[str, tuple[re.Pattern, Callable[[str], bool], Callable[[str], bool]]] = {
    "iban": (re.compile(r"[A-Za-z0-9]"), _iban_ok, lambda s: f"{s[:2]}{len(s.replace(' ', ''))}" in COUNTRIES),
    "card": (re.compile(r"[0-9]"), _card_ok, lambda s: BRANDS.fullmatch(_digits(s)) is not None),
    "intl": (re.compile(r"[0-9]"), _intl_ok, lambda s: True),
}
#: What every find has; keys of letters alone are not told from words.
HINT = re.compile(r"[0-9@]")


@lru_cache(maxsize=1)
def _compiled():
    return [(k, re.compile(p), f) for k, p, f in KINDS]


def _spans(text: str, kind: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """All spans that hold, of every length that the pattern admits at every start, the preferred ones first."""
    follows, ok, known = LENGTHS[kind]
    at, out = 0, []
    while m := pattern.search(text, at):
        start, at = m.start(), m.start() + 1
        while m:
            # a shorter match is made by an early end of the text, which hides what follows
            if not follows.match(text, m.end()) and ok(m[0]):
                out.append(m.span())
            m = pattern.match(text, start, m.end() - 1)
    return sorted(out, key=lambda x: (not known(text[slice(*x)]), x[0] - x[1], x[0]))


def pseudonymised(text: str, key: str) -> tuple[str, list[str]]:
    """The text with pseudonyms for all finds, and the kinds found in order of place."""
    if not HINT.search(text):
        return text, []
    k = key.encode()
    kept: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def keep(start: int, end: int, kind: str, new: str) -> None:
        kept.append((start, end, kind, new))
        taken[start:end] = b"\1" * (end - start)

    for kind, pattern, made in _compiled():
        if kind in LENGTHS:
            for start, end in _spans(text, kind, pattern):
                if taken.find(1, start, end) < 0:
                    keep(start, end, kind, made(text[start:end], k))
            continue
        at = 0
        while m := pattern.search(text, at):
            new = made(m[0], k) if taken.find(1, *m.span()) < 0 else None
            if new is not None:
                keep(*m.span(), kind, new)
            at = m.start() + 1 if new is None else m.end()
    out, at = [], 0
    for start, end, _, new in sorted(kept):
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [x[2] for x in sorted(kept)]


def pseudonymise(df: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """df with its text pseudonymised, n_pii (long) and pii_kinds (array of strings).

    Without counts the columns are df's own. Other columns pass as they are, in Arrow batches."""
    kept = df.drop("n_pii", "pii_kinds") if counts else df
    added = [T.StructField("n_pii", T.LongType()), T.StructField("pii_kinds", T.ArrayType(T.StringType()))]
    schema = T.StructType([*kept.schema.fields, *(added if counts else [])])
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, []) if x is None else pseudonymised(x, key) for at in range(0, len(b), TOGETHER) for x in b.column(place).slice(at, TOGETHER).to_pylist()]
            columns = list(b.columns)
            columns[place] = pa.array([x[0] for x in made], b.schema.field(place).type)
            names = b.schema.names
            if counts:
                columns += [pa.array([len(x[1]) for x in made], pa.int64()), pa.array([x[1] for x in made], pa.list_(pa.string()))]
                names = [*names, "n_pii", "pii_kinds"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tidied(None)

    return kept.mapInArrow(run, schema)


def op10_pii(spark, sf_dir):
    from .common import table

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
