"""Format-preserving pseudonyms for personal data.

Values are found by pattern, checked (check digits, calendar, ranges) and replaced by a keyed permutation of all
values of the same format: a Feistel network over whole numbers, walked on until the result is a valid value of
that format again. One value has one pseudonym under one key, whatever its punctuation, so documents that share a
value stay linked. Nothing is shuffled and no table of values is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from functools import partial
from hashlib import blake2b
from ipaddress import IPv4Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from stratusqc.llm.common import byte_slices, fresh_name, text_bytes, text_or_empty

ROUNDS = 8
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
SPANS = "array<struct<kind:string,start:long,end:long>>"

NUMBERS = re.compile(
    r"""(?P<phone>\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])
      |(?<![0-9A-Za-z(])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])
      |(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])
      |\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9]))
    |(?P<ip>(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z]))
    |(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))
    |(?P<date>(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<mark>[./])[0-9]{1,2}(?P=mark)[0-9]{4})(?![0-9A-Za-z-]))
    |(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))
    |(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}
              |[0-9]{4}(?P<space>[ -])[0-9]{6}(?P=space)[0-9]{5})(?![0-9A-Za-z]))""",
    re.VERBOSE,
)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_AFTER = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
# What follows a short number of its own, as in 24/7, 10:30, 50% and 10am.
GOES_ON = re.compile(r"[/:][0-9]|%|[ap]m(?![A-Za-z])")
DATE_REST = re.compile(r"-[0-9]{2}-[0-9]{2}(?![0-9])")
IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SIGNS = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


#: Letters and digits that are permuted as one number; longer values are permuted block by block.
BLOCK = 128


def _told(data: bytes, size: int, key: bytes, person: bytes) -> bytes:
    """``size`` keyed bytes that all depend on all of ``data``."""
    if size <= 64:
        return blake2b(data, digest_size=size, key=key, person=person).digest()
    seed = blake2b(data, digest_size=64, key=key, person=person).digest()
    blocks = range(1, -(-size // 64) + 1)
    return b"".join(blake2b(seed, key=key, person=person, salt=k.to_bytes(16, "big")).digest() for k in blocks)[:size]


def permute(value: int, size: int, key: bytes, kind: str, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers below ``size``; ``value`` must be one of them."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for turn in range(ROUNDS):
            told = _told(right.to_bytes(width, "big"), width + 8, key, f"{kind}{turn}".encode()[:16])
            left, right = right, left ^ (int.from_bytes(told, "big") & mask)
        value = left << half | right
        if value < size and valid(value):
            return value


def _class(sign: str) -> str | None:
    return next((k for k, signs in SIGNS.items() if sign in signs), None)


def _signs(text: str, key: bytes, kind: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    """Letters and digits of ``text`` permuted within their classes; all else stays where it is."""
    classes = [_class(c) for c in text]
    alphabets = [SIGNS[c] for c in classes if c]
    shape = "".join(c or "" for c in classes)

    def number(signs: Iterable[str]) -> int:
        total = 0
        for sign, alphabet in zip(signs, alphabets):
            total = total * len(alphabet) + alphabet.index(sign)
        return total

    def written(total: int) -> str:
        out = []
        for alphabet in reversed(alphabets):
            total, place = divmod(total, len(alphabet))
            out.append(alphabet[place])
        return "".join(reversed(out))

    size = 1
    for alphabet in alphabets:
        size *= len(alphabet)
    plain = [s for s, c in zip(text, classes) if c]
    new = iter(written(permute(number(plain), size, key, kind + shape[:4], lambda v: valid(written(v)))))
    return "".join(next(new) if c else s for s, c in zip(text, classes))


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _put(text: str, digits: str) -> str:
    new = iter(digits)
    return re.sub("[0-9]", lambda _: next(new), text)


def _check_digit(digits: str) -> str:
    """The Luhn digit that follows ``digits``."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if _check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + _signs(digits[1:-1], key, "card")
    return _put(text, body + _check_digit(body))


def _phone_body(text: str) -> int:
    """How many leading digits are the country's."""
    if not text.startswith("+"):
        return 0
    return 1 if text[1] == "1" else len(re.match(r"\+([0-9]+)", text)[1]) if re.match(r"\+[0-9]{1,3}[ .(-]", text) else 2


def _phone(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    country = _phone_body(text)
    own = digits[country:]
    if len(digits) > 15 or len(own) < 7:
        return None
    # The numbers of one country are one format, whether its code is written or not.
    american = len(own) == 10 and digits[:country] in ("", "1")
    return _put(text, digits[:country] + _signs(own, key, "phone1" if american else "phone" + digits[:country]))


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    return _put(text, _signs(digits, key, "ssn", _ssn_valid)) if _ssn_valid(digits) else None


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts))
    # Public addresses stay public, local ones local.
    public = IPv4Address(value).is_global
    return str(IPv4Address(permute(value, 1 << 32, key, "ip", lambda v: IPv4Address(v).is_global == public)))


def _date(text: str, key: bytes) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    try:
        if mark == "-":
            day, order = date(*map(int, parts)), "ymd"
        elif mark == "." or int(parts[0]) > 12:
            day, order = date(int(parts[2]), int(parts[1]), int(parts[0])), "dmy"
        else:
            day, order = date(int(parts[2]), int(parts[0]), int(parts[1])), "mdy"
    except ValueError:
        return None
    if not 0 <= (day - FIRST_DAY).days < DAYS:
        return None
    new = FIRST_DAY + timedelta(permute((day - FIRST_DAY).days, DAYS, key, "date"))
    values = {"y": new.year, "m": new.month, "d": new.day}
    return mark.join(str(values[o]).zfill(len(p) if len(p) != 1 else 1) for o, p in zip(order, parts))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != check:
        return None
    body = _signs(body, key, "iban" + country)
    new = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(new) for c in text)


def _email(text: str, key: bytes) -> str:
    """All but the last label of the host.

    Of a very long address each block is permuted under a key of its own, made of the blocks before it, so that the
    work stays linear and different addresses stay different.
    """
    head, dot, last = text.rpartition(".")
    out, own = [], key
    for at in range(0, len(head), BLOCK):
        out.append(_signs(head[at : at + BLOCK], own, "email"))
        own = blake2b(head[: at + BLOCK].encode(), digest_size=32, key=key).digest() if at + BLOCK < len(head) else key
    return "".join(out) + dot + last


_RULES = {"phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "iban": _iban, "card": _card, "email": _email}


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of ``value``, or nothing if it isn't a valid one of its kind."""
    return _RULES[kind](value, key)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of all addresses; the name before the @ reaches back to the last sign that can't be in one."""
    done, at = 0, text.find("@")
    while at >= 0:
        after = EMAIL_AFTER.match(text, at + 1)
        if after:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            while start < at and not text[start].isalnum():
                start += 1
            if start < at:
                yield start, after.end()
                done = after.end()
        at = text.find("@", at + 1)


def _kind(match: re.Match) -> str:
    return next(k for k in _RULES if k != "email" and match[k])


def _iban_ends(text: str, start: int, end: int) -> list[int]:
    """Where an IBAN may end: at its country's length first; of other countries at every gap, the longest first."""
    gaps = [e for e in range(start + 15, end + 1) if e == end or text[e] == " "]
    size = IBAN_LENGTHS.get(text[start : start + 2])
    if size is None:
        return gaps[::-1]
    return [e for e in gaps if e - start - text.count(" ", start, e) == size] + [end]


def _phone_ends(text: str, start: int, end: int, emails: set[int], key: bytes) -> list[int]:
    """Where an international number may end: before another value if it can, else as late as it can."""
    ends, cut = [], []
    for e in range(start + 8, end + 1):
        if text[e - 1] not in "0123456789)" or text[e : e + 1] in tuple("0123456789)") or _phone(text[start:e], key) is None:
            continue
        if ends and _begins(text, ends[-1] + 1, emails, key):
            break
        runs = re.findall("[0-9]+", text[start:e])
        inside = e < end and text[e] in ".-"
        short = len(runs[-1]) <= 2 < len(runs[-2]) and GOES_ON.match(text, e)
        (cut if inside or short or len(runs[-1]) == 4 and DATE_REST.match(text, e) else ends).append(e)
    return ends[::-1] + cut[::-1]


def _begins(text: str, start: int, emails: set[int], key: bytes) -> bool:
    """Whether a value that holds begins right there."""
    match = NUMBERS.match(text, start)
    return start in emails or match is not None and _held(text, match, emails, key) is not None


def _held(text: str, match: re.Match, emails: set[int], key: bytes) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the value that a match begins with, if its check holds."""
    kind, start, end = _kind(match), match.start(), match.end()
    ends = [end]
    if kind == "iban":
        ends = _iban_ends(text, start, end)
    elif kind == "phone" and text[start] == "+" and text[start + 1] != "1":
        ends = _phone_ends(text, start, end, emails, key)
    for e in ends:
        new = pseudonym(kind, text[start:e], key)
        if new is not None:
            return kind, e, new
    return None


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end of each value in the text as it was.

    A match that fails its check takes nothing away: the search goes on at its second sign.
    """
    emails = list(_emails(text))
    begins = {s for s, _ in emails}
    out, spans, done, at, turn = [], [], 0, 0, 0
    match = NUMBERS.search(text)
    while True:
        while turn < len(emails) and emails[turn][0] < done:
            turn += 1
        at = max(at, done)
        if match is not None and match.start() < at:
            match = NUMBERS.search(text, at)
        email = emails[turn] if turn < len(emails) else None
        if email is not None and (match is None or (email[0], -email[1]) <= (match.start(), -match.end())):
            start, end = email
            kind, new = "email", pseudonym("email", text[start:end], key)
            turn += 1
        elif match is not None:
            start = match.start()
            held = _held(text, match, begins, key)
            if held is None:
                at = start + 1
                continue
            kind, end, new = held
        else:
            break
        out += [text[done:start], new]
        spans.append((kind, start, end))
        done = end
    return "".join([*out, text[done:]]), spans


def _run(batches: Iterable[pa.RecordBatch], key: bytes, whole: str, name: str) -> Iterator[pa.RecordBatch]:
    """Replaces column ``text``; ``whole`` is that column without nulls, which is taken out."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in byte_slices(batches, whole):
        raw, starts = text_bytes(part.column(whole))
        marks = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))])
        maybe = np.flatnonzero(marks[starts[1:]] > marks[starts[:-1]])
        texts, found_in = part.column("text").to_pylist(), [[] for _ in range(part.num_rows)]
        for k in maybe.tolist():
            texts[k], found = replace(texts[k], key)
            found_in[k] = [{"kind": n, "start": s, "end": e} for n, s, e in found]
        columns = {n: part.column(n) for n in part.schema.names if n != whole} | {"text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found_in, kind)], names=[*columns, name])


def pseudonymise(docs: DataFrame, key: bytes, spans: str = "pii_spans") -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text``, and column ``spans``: kind, start, end in the old text.

    Offsets are in code points, ends exclusive. Numbers that fail their check, and dates that don't exist, stay.
    A null text stays null and has no spans; repeated rows are treated alike; other columns are not changed.
    ``key`` is 1 to 64 secret bytes.
    """
    whole = fresh_name(docs, "whole_text")
    kinds = [StructField(f.name, StringType() if f.name == "text" else f.dataType, True) for f in docs.schema.fields]
    kinds.append(StructField(spans, _parse_datatype_string(SPANS), True))
    return docs.withColumn(whole, text_or_empty()).mapInArrow(partial(_run, key=key, whole=whole, name=spans), StructType(kinds))


def hide(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; a column n_chars keeps telling the length of the text."""
    marker = fresh_name(docs, "pii_spans")
    out = pseudonymise(docs, key, marker)
    if "n_chars" in docs.columns:
        length = F.when(F.size(marker) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.drop(marker)
