"""Format-preserving pseudonyms for personal values.

Candidates (e-mail and IPv4 addresses, payment cards, phone numbers, US social
security numbers, IBANs, dates, assigned secret tokens) are found by pattern and
kept only if they validate (Luhn, mod 97, octets, calendar, ...).  Each valid
value is numbered within its format, the number is permuted by a keyed Feistel
network over that format's whole range, and the permuted value is written back
in the found layout.  Equal values get equal pseudonyms in every document and layout,
different values never get the same one, and pseudonyms validate again.  Dates after the
twelfth of a month stay after it and earlier ones before: so a date that could only be
month-first stays one, and no date of either order is read as the other.

One pass over the texts, no shuffle, no state.  Defined results: a null text
stays null, with no spans; an empty text stays empty; all matches of a text of any
length are handled; overlapping candidates go to the kind listed first;
equal rows give equal results; values that do not validate stay as they are.  Phone
numbers in the national layout whose area code or exchange starts with 0 or 1 (no
NANP numbers) are permuted among numbers of that kind.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import buffer, per_document, slices

ROUNDS = 10
LONG = 256                # symbols of a value that are permuted as one number
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

Replace = Callable[[re.Match, bytes], str | None]


def feistel(number: int, size: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of ``range(size)``: a balanced Feistel network over the
    next even power of two, walked until the value is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = number >> half, number & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(bytes([r]) + tweak + b"\0" + right.to_bytes(width, "big"), key=key[:64],
                                digest_size=min(64, width + 8)).digest()
            while len(f) < width:
                f += hashlib.blake2b(f, key=key[:64]).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        number = left << half | right
        if number < size:
            return number


def permute(symbols: str, alphabets: list[str], key: bytes, tweak: bytes) -> str:
    """Permute a string whose i-th symbol is drawn from ``alphabets[i]``."""
    number, size = 0, 1
    for s, a in zip(symbols, alphabets):
        number, size = number * len(a) + a.index(s), size * len(a)
    number, out = feistel(number, size, key, tweak), []
    for a in reversed(alphabets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def permute_long(symbols: str, alphabets: list[str], key: bytes, tweak: bytes) -> str:
    """:func:`permute` in time proportional to the length: blocks of ``LONG`` symbols,
    each permuted under a tweak of all before it, then from the end under one of
    all (new) after it, so every symbol depends on the whole string."""
    if len(symbols) <= LONG:
        return permute(symbols, alphabets, key, tweak)
    at = range(0, len(symbols), LONG)
    blocks = [symbols[i:i + LONG] for i in at]
    for order in (range(len(at)), range(len(at) - 1, -1, -1)):
        seen = hashlib.blake2b(tweak + b"%d" % order[0], key=key[:64])
        for b in order:
            old = blocks[b]
            blocks[b] = permute(old, alphabets[at[b]:at[b] + LONG], key, b"block" + seen.digest())
            seen.update((blocks[b] if order[0] else old).encode())
    return "".join(blocks)


def _classes(text: str) -> list[str] | None:
    found = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), None) for c in text]
    return None if None in found else found


def _laid_out(found: str, symbols: str, is_symbol) -> str:
    """``symbols`` set in the places of the found text that hold symbols."""
    new = iter(symbols)
    return "".join(next(new) if is_symbol(c) else c for c in found)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub("[ -]", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + permute(digits[1:-1], [DIGITS] * (len(digits) - 2), key, b"card%d" % len(digits) + digits[:1].encode())
    return _laid_out(m[0], body + luhn_digit(body), str.isdigit)


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = "".join(c for c in m[0] if c in DIGITS)
    if m["national"] or (len(digits) == 11 and m[0].startswith("+1")):      # +1 in any layout
        own = digits[-10:]
        if own[0] in "01" or own[3] in "01":
            new = permute(own, [DIGITS] * 10, key, b"national10")
            while not (new[0] in "01" or new[3] in "01"):    # walked past the NANP numbers
                new = permute(new, [DIGITS] * 10, key, b"national10")
        else:
            new = permute(own, [DIGITS[2:], DIGITS, DIGITS, DIGITS[2:], *[DIGITS] * 6], key, b"nanp")
        return _laid_out(m[0], digits[:-10] + new, lambda c: c in DIGITS)
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    return _laid_out(m[0], digits[:2] + permute(digits[2:], [DIGITS] * (len(digits) - 2), key,
                                                b"phone%d" % len(digits) + digits[:2].encode()), lambda c: c in DIGITS)


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    n = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    n = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    name, _, top = domain.rpartition(".")
    whole = f"{local}@{name}"
    symbols = "".join(c for c in whole.lower() if c in DIGITS or c in LOWER)
    classes = _classes(symbols)
    shape = "".join("9" if c in DIGITS else "a" if c.lower() in LOWER else c for c in whole)
    new = iter(permute_long(symbols, classes, key, b"email" + shape.encode() + b"." + top.lower().encode()))
    return "".join(c if c not in DIGITS and c.lower() not in LOWER else next(new).upper() if c in UPPER else next(new)
                   for c in whole) + "." + top


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != check:
        return None
    classes = _classes(body)
    shape = "".join("9" if c in DIGITS else "A" for c in body)
    new = permute(body, classes, key, b"iban" + country.encode() + shape.encode())
    return _laid_out(m[0], country + _iban_check(country, new) + new, lambda c: c != " ")


def _new_day(day: int, key: bytes) -> datetime.date:
    """The permuted day, walked on until it is on the same side of the twelfth."""
    late = datetime.date.fromordinal(day).day > 12
    while True:
        day = FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date")
        new = datetime.date.fromordinal(day)
        if (new.day > 12) == late:
            return new


def _date(m: re.Match, key: bytes) -> str | None:
    if m["iso"]:
        y, mo, d = int(m["y"]), int(m["m"]), int(m["d"])
    else:
        d, mo, y = int(m["d2"]), int(m["m2"]), int(m["y2"])
    swapped = not m["iso"] and m["sep2"] in "/-" and mo > 12 >= d      # month first
    if swapped:
        d, mo = mo, d
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = _new_day(day, key)
    if m["iso"]:
        return f"{new.year:04d}{m['sep']}{new.month:02d}{m['sep']}{new.day:02d}"
    # A field is written with two digits if it was, unless the other shows that it needs not be.
    fields = m["d2"], m["m2"]
    two = [f[0] == "0" or (len(f) == 2 and len(other) == 2) for f, other in (fields, fields[::-1])]
    a, b = (f"{n:02d}" if wide else str(n) for n, wide in zip((new.month, new.day) if swapped else (new.day, new.month), two))
    return f"{a}{m['sep2']}{b}{m['sep2']}{new.year:04d}"


def _secret(m: re.Match, key: bytes) -> str | None:
    value = m["value"]
    alphabets = [HEX] * len(value) if set(value) <= set(HEX) else _classes(value.replace("-", "").replace("_", ""))
    symbols = value if set(value) <= set(HEX) else value.replace("-", "").replace("_", "")
    if not alphabets or len(set(symbols)) < 4:
        return None
    shape = b"".join(str(len(a)).encode() for a in alphabets)
    new = permute_long(symbols, alphabets, key, b"secret" + hashlib.sha256(shape).digest())
    return m["before"] + _laid_out(value, new, lambda c: c not in "-_" or symbols == value)


# Kinds in order of precedence: name, pattern, pseudonym.  Numbers do not start
# or end inside a longer run of digits or dotted digits; a time may follow an ISO date.
_START, _END = r"(?<![0-9A-Za-z])(?<![0-9][.\-])", r"(?![0-9A-Za-z])(?![.\-][0-9])"
KINDS: list[tuple[str, str, Replace]] = [
    ("secret", r"(?P<before>(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)"
               r"(?P<value>[0-9A-Za-z_\-]{16,})", _secret),
    ("email", r"(?<![0-9A-Za-z_%+\-])(?<![0-9A-Za-z_%+\-]\.)[0-9A-Za-z_%+\-][0-9A-Za-z._%+\-]{0,63}@"
              r"(?:[0-9A-Za-z](?:[0-9A-Za-z\-]{0,61}[0-9A-Za-z])?\.)+[A-Za-z]{2,24}(?![0-9A-Za-z\-])", _email),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("card", _START + r"[0-9](?:[0-9]{12,18}|[0-9]{3}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,3})?"
             r"|[0-9]{3}[ \-][0-9]{6}[ \-][0-9]{5})" + _END, _card),
    ("ssn", _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END, _ssn),
    ("ip", r"(?<![0-9A-Za-z])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])", _ip),
    ("date", _START + r"(?:(?P<iso>(?P<y>[12][0-9]{3})(?P<sep>[\-/.])(?P<m>[0-9]{2})(?P=sep)(?P<d>[0-9]{2}))"
             r"(?:(?=[Tt][0-9])|" + _END + r")|(?P<d2>[0-9]{1,2})(?P<sep2>[/.\-])(?P<m2>[0-9]{1,2})(?P=sep2)(?P<y2>[12][0-9]{3})"
             + _END + ")", _date),
    ("phone", r"(?<![0-9A-Za-z+])(?<![0-9][.\-])(?:(?P<national>(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])"
              r"[0-9]{3}[ .\-][0-9]{4})|\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,6})" + _END, _phone),
]
_COMPILED = [(name, re.compile(pattern), replace) for name, pattern, replace in KINDS]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@lru_cache(maxsize=1 << 14)
def _again(name: str, found: str, key: bytes) -> str | None:
    """The pseudonym of one found text (the same in every document)."""
    kind = next(k for k in _COMPILED if k[0] == name)
    m = kind[1].match(found)
    return kind[2](m, key) if m and m[0] == found else None


def pseudonymise_text(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the replaced spans (kind, start, end) in
    code points of the original text."""
    hits: list[tuple[int, int, str, str]] = []
    for name, pattern, replace in _COMPILED:
        for m in pattern.finditer(text):
            new = len(m[0]) <= 2 * LONG and _again(name, m[0], key) or replace(m, key)
            if new is not None:
                hits.append((m.start() + (len(m["before"]) if name == "secret" else 0), m.end(), name,
                             new[len(m["before"]):] if name == "secret" else new))
    rank = {k[0]: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str, str]] = []
    end = {}
    for h in sorted(hits, key=lambda h: (rank[h[2]], h[0])):
        cells = range(h[0] >> 3, (h[1] - 1 >> 3) + 1)
        if any(h[0] < o[1] and o[0] < h[1] for c in cells for o in end.get(c, ())):
            continue
        taken.append(h)
        for c in cells:
            end.setdefault(c, []).append(h)
    out, at = [], 0
    for s, e, _, new in sorted(taken):
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], [(k, s, e) for s, e, k, _ in sorted(taken)]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised under the secret ``key``, and
    ``n_values`` and ``spans``.  Input columns of those names are replaced."""
    rest = [c for c in docs.columns if c not in (text_col, "n_values", "spans")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text_col).alias("text"))

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, "text"):
            data, offsets = buffer(b.column("text"))
            # Every kind holds an @ or a digit, except secrets of letters alone, which hold = or :.
            flags = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 61) | (data == 58)
            may = per_document(flags.astype(np.int8), offsets) > 0
            texts, spans = b.column("text").to_pylist(), []
            for i, text in enumerate(texts):
                found = []
                if text and may[i]:
                    texts[i], found = pseudonymise_text(text, key)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("rest"), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, kind)], ["rest", "text", "n_values", "spans"])

    schema = f"rest {own.schema['rest'].dataType.simpleString()}, text string, n_values bigint, spans {SPANS}"
    done = shared.ready(own).mapInArrow(run, schema)
    return done.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("text").alias(text_col), "n_values", "spans")
