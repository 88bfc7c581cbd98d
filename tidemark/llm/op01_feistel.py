"""Format-preserving pseudonyms: validated numbers and dates are keyed permutations within their format.

Candidates are found by one pattern per format and validated (check digits, ranges, lengths).  The value, without
its separators, is permuted by a Feistel network over its own domain (balanced halves, keyed BLAKE2 rounds, cycle
walking where the domain is smaller than the halves' product), and written back in the same layout.  Equal values
of a kind get equal pseudonyms in every document and every layout, check digits stay valid, dates stay dates, and
the holder of the key can invert it (but for a run of groups that a pseudonym turns into another reading, as where the
ends of one run could each be a card).  Map-only: no shuffle, no state, nothing but the key leaves the driver.

Kinds: card (13 to 19 digits with a valid Luhn digit), iban (mod 97), account (any other run of 13 to 19 digits),
phone, ssn, ipv4, date (ISO, day.month.year, month/day/year, or day/month/year where the day is above 12, between
1900 and 2099), email (letters and digits of the local part).  Overlapping candidates: the first in the text, then the
first layout of the list, wins.  A candidate that fails is tried with shorter ends and as the other kinds, then the
search goes on inside it.  A valid card at the head or tail of a longer run of groups is that card, whatever follows.

Edge cases: null text is empty with no finds; doc_id may be null; texts of any length are read whole; repeated
rows give equal results; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

ROUNDS = 10
KEY = b"replace this key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)"
_IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
CANDIDATE = re.compile(
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    rf"|(?P<date>(?<![\d./-]){_DATE})"
    rf"|(?P<ipv4>(?<![\d.]){_IPV4})"
    rf"|(?P<ssn>(?<![\d-]){_SSN})"
    r"|(?P<long>(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d|-\d))"
    rf"|(?P<phone>(?<![\w+])\+\d(?:\d|[ .-]?\((?:0|\d{{2,4}})\)|[ .-](?!{_DATE}|{_IPV4}|{_SSN})\d|(?<=\))[ .-]?\d){{5,14}}(?!\d)"
    r"|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))")
KINDS = [(kind, re.compile(part)) for kind, part in zip(
    CANDIDATE.groupindex, re.split(r"\|(?=\(\?P<)", CANDIDATE.pattern))]
#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
CARDS = frozenset([(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (13,), (14,), (15,), (16,)])
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")


class Feistel:
    """A keyed permutation of range(size), with a tweak that separates kinds."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = math.isqrt(size - 1) + 1
        self.state = hashlib.blake2b(tweak.encode() + b"/" + str(size).encode(), key=key[:64], digest_size=16)
        self.width = (self.half.bit_length() + 7) // 8 + 1

    def _round(self, i: int, right: int) -> int:
        h = self.state.copy()
        h.update(bytes([i]) + right.to_bytes(self.width, "big"))
        return int.from_bytes(h.digest(), "big")

    def __call__(self, value: int) -> int:
        while True:
            left, right = divmod(value, self.half)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right)) % self.half
            value = left * self.half + right
            if value < self.size:
                return value

    def inverse(self, value: int) -> int:
        while True:
            left, right = divmod(value, self.half)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, left)) % self.half, left
            value = left * self.half + right
            if value < self.size:
                return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _valid(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1])


def card_ends(digits: str) -> tuple[bool, ...]:
    """Whether all the digits, and the shorter runs of 13 to 16 at the head and the tail, have a valid check digit."""
    shorter = [n for n in (13, 14, 15, 16) if n < len(digits)]
    return _valid(digits), *(_valid(digits[:n]) for n in shorter), *(_valid(digits[-n:]) for n in shorter)


def card_in(found: str) -> tuple[int, int]:
    """Start and end of the card that whole groups at the head, else the tail, of ``found`` form; of all where there is none."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", found)]
    for n in range(len(groups) - 1, 0, -1):
        for part in (groups[:n], groups[-n:]):
            if tuple(b - a for a, b in part) in CARDS:
                lo, hi = part[0][0], part[-1][1]
                if _valid(re.sub(r"\D", "", found[lo:hi])):
                    return lo, hi
    return 0, len(found)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _fill(layout: str, chars: str, kinds: str) -> str:
    """``layout`` with its characters of the given kinds replaced in turn."""
    it = iter(chars)
    return "".join(next(it) if re.match(kinds, c) else c for c in layout)


class Pseudonyms:
    """Pseudonyms under one key; ``forward`` False inverts them."""

    def __init__(self, key: bytes = KEY, forward: bool = True):
        self.key, self.forward, self._known, self._memo = key, forward, {}, {}

    def _permute(self, kind: str, size: int, value: int) -> int:
        known = self._known.get((kind, size))
        if known is None:
            known = self._known[kind, size] = Feistel(self.key, kind, size)
        return known(value) if self.forward else known.inverse(value)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._permute(kind, 10 ** len(digits), int(digits))).zfill(len(digits))

    def _mixed(self, kind: str, chars: str) -> str:
        """A permutation of strings with the same pattern of digits, small and capital letters."""
        bases = [(10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") for c in chars]
        value, size = 0, 1
        for c, (base, zero) in zip(chars, bases):
            value, size = value * base + ord(c) - ord(zero), size * base
        value = self._permute(kind, size, value)
        out = []
        for base, zero in reversed(bases):
            value, d = divmod(value, base)
            out.append(chr(ord(zero) + d))
        return "".join(reversed(out))

    def replace(self, kind: str, found: str) -> tuple[str, str] | None:
        """(kind, pseudonym) of a candidate, or None where it does not validate."""
        key = kind, found
        if key not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[key] = getattr(self, f"_{kind}")(found)
        return self._memo[key]

    def _long(self, found: str):
        digits = re.sub(r"\D", "", found)
        sign = card_ends(digits)
        # permuted until the value ends in as many cards as before, so that kinds stay apart in every layout
        while True:
            if sign[0]:
                body = self._digits("card", digits[:-1])
                digits = body + str(luhn(body))
            else:
                digits = self._digits("account", digits)
            if card_ends(digits) == sign:
                return "card" if sign[0] else "account", _fill(found, digits, r"\d")

    def _iban(self, found: str):
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        body = self._mixed("iban" + plain[:2], plain[4:])
        check = 98 - mod97(plain[:2] + "00" + body)
        return "iban", _fill(found, f"{plain[:2]}{check:02d}{body}", r"\w")

    def _phone(self, found: str):
        start = 0
        if found[0] == "+":  # the country code stays, however it is set apart
            code = COUNTRY.match(re.sub(r"\D", "", found))
            if not code:
                return None
            ends = [m.end() for m in re.finditer(r"\d", found)]
            start = ends[len(code.group()) - 1]
            if code.group() == "1" and len(ends) > 11:
                return None
        head, trunk, rest = found[start:].partition("(0)")
        digits = re.sub(r"\D", "", head + rest)
        if not 5 <= len(digits) <= 14:
            return None
        digits = self._digits("phone", digits)
        cut = len(re.sub(r"\D", "", head))
        return "phone", found[:start] + _fill(head, digits[:cut], r"\d") + trunk + _fill(rest, digits[cut:], r"\d")

    def _ssn(self, found: str):
        return "ssn", _fill(found, self._digits("ssn", re.sub(r"\D", "", found)), r"\d")

    def _ipv4(self, found: str):
        parts = [int(p) for p in found.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in found.split(".")):
            return None
        value = self._permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return "ipv4", ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, found: str):
        parts = re.split(r"[./-]", found)
        order = (0, 1, 2) if "-" in found else (2, 1, 0) if "." in found or int(parts[0]) > 12 else (2, 0, 1)
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        late = datetime.date.fromordinal(day).day > 12
        while True:  # days above 12 stay so, as they tell day/month from month/day
            day = FIRST_DAY + self._permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY)
            new = datetime.date.fromordinal(day)
            if (new.day > 12) == late:
                break
        values = dict(zip(order, (new.year, new.month, new.day)))
        sep = found[4] if "-" in found else "." if "." in found else "/"
        width = {i: 4 if values[i] == new.year and i == order[0] else 2 for i in range(3)}
        pad = "-" in found or all(len(parts[i]) == 2 for i in range(2))
        return "date", sep.join(str(values[i]).zfill(width[i] if pad or i == order[0] else 1) for i in range(3))

    def _email(self, found: str):
        chars = re.sub(r"[^A-Za-z0-9]", "", found)
        return "email", _fill(found, self._mixed("email", chars), r"[A-Za-z0-9]")

    def _candidate(self, text: str, match: re.Match) -> tuple[int, int, str, str] | None:
        """(start, end, kind, pseudonym) of the first kind that validates where ``match`` starts."""
        a, first = match.start(), match.lastgroup
        for kind, pattern in KINDS:
            m = match if kind == first else pattern.match(text, a)
            if not m:
                continue
            value = m.group()
            # shorter ends stop where a group of the candidate ends
            ends = [len(value), *(e.start() for e in reversed(list(re.finditer(r"[ .-]", value))))] if kind in ("iban", "phone") else [len(value)]
            if kind == "long":
                lo, hi = card_in(value)
                return a + lo, a + hi, *self.replace(kind, value[lo:hi])
            for end in ends:
                new = self.replace(kind, value[:end])
                if new:
                    return a, a + end, *new
        return None

    def text(self, text: str | None) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text under pseudonyms and its finds: kind, start and end in the given text, pseudonym."""
        text = text or ""
        mails = [(m.start(), m.end()) for m in EMAIL.finditer(text)] if "@" in text else []
        some = re.search(r"\d", text) is not None
        out, finds, at, look, mail = [], [], 0, 0, 0
        match = CANDIDATE.search(text) if some else None
        while match or mail < len(mails):
            if mail < len(mails) and (not match or mails[mail][0] <= match.start()):
                a, b = mails[mail]
                mail += 1
                hit = (a, b, *self.replace("email", text[a:b])) if a >= at else None
                look = max(look, a)
            else:
                hit = self._candidate(text, match)
                look = match.start() + 1
            if hit:
                a, b, kind, new = hit
                out += [text[at:a], new]
                finds.append((kind, a, b, new))
                at = look = b
            if match and match.start() < look:
                match = CANDIDATE.search(text, look)
        return "".join([*out, text[at:]]), finds


def pseudonymise(docs: DataFrame, key: bytes = KEY, forward: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, text under pseudonyms, n_found, found (kind, start, end, pseudonym)."""
    bounded_batches(docs.sparkSession)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, forward)
        for batch in batches:
            rows = [names.text(t) for t in batch.column("text").to_pylist()]
            finds = [[dict(zip(("kind", "start", "end", "pseudonym"), f)) for f in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([len(f) for f in finds], pa.int64()), pa.array(finds, struct)], ["doc_id", "text", "n_found", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, f"doc_id {kind}, text string, n_found long, found array<struct<kind:string,start:int,end:int,pseudonym:string>>")
