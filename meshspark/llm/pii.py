"""Format-preserving pseudonyms for personal data."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import holding, map_arrow

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n: a Feistel network over two nearly equal factors, walked until inside."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, i: int, half: int, n: int, tag: str) -> int:
        digest = hashlib.blake2b(f"{tag}|{n}|{i}|{half}".encode(), key=self.key, digest_size=32).digest()
        if n.bit_length() > 300:  # halves of long values need more bits than one digest has
            digest = hashlib.shake_256(digest).digest(n.bit_length() // 16 + 16)
        return int.from_bytes(digest, "big")

    def permuted(self, x: int, n: int, tag: str, back: bool = False) -> int:
        """Where x goes within its tag's permutation of 0 .. n - 1; with back, where it came from."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            l, r = divmod(x, b)
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                if i % 2:
                    step = self._round(i, l, n, tag)
                    r = (r + (-step if back else step)) % b
                else:
                    step = self._round(i, r, n, tag)
                    l = (l + (-step if back else step)) % a
            x = l * b + r
            if x < n:
                return x

    def other(self, x: int, n: int, tag: str, back: bool = False) -> int:
        """A permutation that leaves nothing in place: one step on in the keyed order, around its end; with back, undone."""
        return self.permuted((self.permuted(x, n, tag) + (-1 if back else 1)) % n, n, tag, back=True)


def luhn(digits: str) -> int:
    """The check digit that goes after these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _refilled(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """Finds personal data and secrets by format, validates them, and permutes each within its format.

    Equal values get equal pseudonyms everywhere, whatever their punctuation. What does not validate stays.
    """

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    # Each method takes the match and gives its pseudonym, or None if it isn't what it looks like.

    def card(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m[0])
        if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = d[1:-1]  # the first digit tells the network
        new = d[0] + str(self.feistel.other(int(body), 10 ** len(body), f"card{len(d)}{d[0]}")).zfill(len(body))
        return _refilled(m[0], new + str(luhn(new)))

    def iban(self, m: re.Match) -> str | None:
        s = re.sub(r"\s", "", m[0])
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
            return None
        body = self.text(s[4:], f"iban{s[:2]}")
        new = s[:2] + f"{98 - number(body + s[:2] + '00') % 97:02d}" + body
        it = iter(new)
        return "".join(c if c.isspace() else next(it) for c in m[0])

    def phone(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m[0])
        if m[0].startswith("+1") or (len(d) == 10 and not m[0].startswith("+")):
            d = d[-10:]
            if len(d) != 10:
                return None
            # All ten digits are free; area codes from 2 to 9 stay such, and so do those with 0 or 1.
            low, n = (0, 2 * 10**9) if d[0] < "2" else (2 * 10**9, 8 * 10**9)
            new = str(low + self.feistel.other(int(d) - low, n, f"phone1{low}")).zfill(10)
            whole = re.sub(r"\D", "", m[0])[:-10] + new
            return _refilled(m[0], whole)
        if not 9 <= len(d) <= 15:
            return None
        tail = d[3:]
        return _refilled(m[0], d[:3] + str(self.feistel.other(int(tail), 10 ** len(tail), f"phone{d[:3]}{len(d)}")).zfill(len(tail)))

    def ssn(self, m: re.Match) -> str | None:
        area, group, serial = m[0][:3], m[0][4:6], m[0][7:]
        if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
            return None
        areas = int(area) - 1 - (area > "666")
        x = self.feistel.other((areas * 99 + int(group) - 1) * 9999 + int(serial) - 1, 898 * 99 * 9999, "ssn")
        x, serial_new = divmod(x, 9999)
        area_new, group_new = divmod(x, 99)
        area_new += 1 + (area_new >= 665)
        return f"{area_new:03d}{m[0][3]}{group_new + 1:02d}{m[0][6]}{serial_new + 1:04d}"

    def ip(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = 0
        for p in parts:
            x = x * 256 + int(p)
        x = self.feistel.other(x, 1 << 32, "ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def date(self, m: re.Match) -> str | None:
        g = m.groupdict()
        y, mo, d = (g["y"], g["m"], g["d"]) if g.get("y") else (g["y2"], g["m2"], g["d2"])
        swapped = False
        try:
            day = datetime.date(int(y), int(mo), int(d))
        except ValueError:
            try:  # day and month the other way round
                day, swapped = datetime.date(int(y), int(d), int(mo)), True
            except ValueError:
                return None
        if not _FIRST_DAY <= day.toordinal() <= _LAST_DAY:
            return None
        n = self.feistel.other(day.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date")
        new = datetime.date.fromordinal(_FIRST_DAY + n)
        mo_new, d_new = (new.day, new.month) if swapped else (new.month, new.day)
        s1, s2 = m["s"] or m["s2"], m["s"] or m["s2"]
        pad = lambda v, old: str(v).zfill(len(old)) if old[0] == "0" or len(old) == 2 else str(v)
        if g.get("y"):
            return f"{new.year}{s1}{pad(mo_new, mo)}{s2}{pad(d_new, d)}"
        return f"{pad(d_new, d)}{s1}{pad(mo_new, mo)}{s2}{new.year}"

    def ipv6(self, m: re.Match) -> str | None:
        try:
            x = ipaddress.IPv6Address(m[0])
        except ValueError:
            return None
        if sum(map(bool, m[0].split(":"))) < 3:
            return None
        new = ipaddress.IPv6Address(self.feistel.other(int(x), 1 << 128, "ipv6"))
        out = new.exploded if len(m[0]) == 39 else str(new)
        return out.upper() if m[0].isupper() else out

    def named_date(self, m: re.Match) -> str | None:
        """A date with the name of its month, in English."""
        day, month, year = (m["nd"], m["nm"], m["ny"]) if m["nd"] else (m["md"], m["mm"], m["my"])
        number = next(i for i, name in enumerate(_MONTHS, 1) if name.startswith(month.lower()[:3]))
        try:
            at = datetime.date(int(year), number, int(day)).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= at <= _LAST_DAY:
            return None
        new = datetime.date.fromordinal(_FIRST_DAY + self.feistel.other(at - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date"))
        name = _MONTHS[new.month - 1]
        name = name[:3] if len(month) < 4 and month.lower() != "may" else name
        name = name.upper() if month.isupper() else name.title() if month[0].isupper() else name
        parts = sorted(((m.start(g), len(m[g]), v) for g, v in (("nd" if m["nd"] else "md", str(new.day)), ("nm" if m["nd"] else "mm", name), ("ny" if m["nd"] else "my", str(new.year)))), reverse=True)
        out = m[0]
        for start, n, v in parts:
            out = out[: start - m.start()] + v + out[start - m.start() + n :]
        return out

    def token(self, m: re.Match) -> str:
        return m["lead"] + self.text(m["body"], f"token{m['lead']}")

    def private_key(self, m: re.Match) -> str:
        """The lines of the body, digits for digits and letters for letters."""
        return m["begin"] + self.text(m["inner"], "key") + m["finish"]

    def text(self, s: str, tag: str) -> str:
        """Digits for digits, letters for letters of the same case, all else stays; permuted as one number."""
        bases = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in s]
        x, n = 0, 1
        for c, b in zip(s, bases, strict=True):
            if b > 1:
                x, n = x * b + (int(c) if b == 10 else ord(c.lower()) - 97), n * b
        shape = "".join("9" if b == 10 else ("A" if c.isupper() else "a") if b == 26 else c for c, b in zip(s, bases, strict=True))
        x = self.feistel.other(x, n, f"{tag}{shape}")
        out = []
        for c, b in zip(reversed(s), reversed(bases), strict=True):
            if b == 1:
                out.append(c)
                continue
            x, digit = divmod(x, b)
            new = str(digit) if b == 10 else chr(97 + digit)
            out.append(new.upper() if c.isupper() else new)
        return "".join(reversed(out))

    def email(self, m: re.Match) -> str | None:
        local, domain = m[0].lower().rsplit("@", 1)
        new = self.text(local, f"email@{domain}")
        return new + "@" + m[0].rsplit("@", 1)[1]

    def hexadecimal(self, s: str, tag: str) -> str:
        upper = s.isupper()
        new = f"{self.feistel.other(int(s, 16), 16 ** len(s), tag):x}".zfill(len(s))
        return new.upper() if upper else new

    def access_key(self, m: re.Match) -> str | None:
        body = m[0][4:]
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        x = 0
        for c in body:
            x = x * 36 + alphabet.index(c)
        x = self.feistel.other(x, 36 ** len(body), "access")
        out = ""
        for _ in body:
            x, d = divmod(x, 36)
            out = alphabet[d] + out
        return m[0][:4] + out

    def secret(self, m: re.Match) -> str | None:
        value = m["value"]
        new = self.hexadecimal(value, "hex") if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else self.text(value, "secret")
        at = m.start("value") - m.start()
        return m[0][:at] + new + m[0][at + len(value) :]


# The months.
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = "(?i:" + "|".join(f"{m}|{m[:3]}" for m in _MONTHS) + "|sept)"
#: Kind, pattern, what else must be in a text for the pattern to match; earlier kinds win.
KINDS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("secret", r"(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{8,})"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("private_key", r"(?P<begin>-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)(?P<inner>[A-Za-z0-9+/=\s]{16,20000}?)(?P<finish>-----END )"),
    ("token", r"(?<![A-Za-z0-9_])(?P<lead>gh[opsur]_|github_pat_|sk_live_|sk_test_|pk_live_|rk_live_|sk-|xox[abprs]-|glpat-|AIza)(?P<body>[A-Za-z0-9_-]{16,})"),
    ("ipv6", r"(?<![\w.:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:]|\.\d)|(?<![\w.:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:]|\.\d)"),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"),
    ("date", r"(?<![\w./-])(?:(?P<y>(?:19|20)\d\d)(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>(?:19|20)\d\d))(?!(?!T\d\d)[\w/-]|\.\d)"),
    ("named_date", rf"(?<![\w./-])(?:(?P<nd>\d{{1,2}})(?:st|nd|rd|th)? (?:of )?(?P<nm>{_MONTH})\.?,? (?P<ny>(?:19|20)\d\d)|(?P<mm>{_MONTH})\.? (?P<md>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<my>(?:19|20)\d\d))(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    ("phone", r"(?<![\w.+-])(?:\+1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+(?!1[ .(-])\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6})(?![\w-]|\.\d)"),
]
#: Lengths of IBANs by country.
_IBAN = dict(re.findall(r"([A-Z]{2})(\d\d)", "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"))
#: Digits of telephone numbers of countries where all have as many, country code included.
_PHONE = {"31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "48": 11, "61": 11, "7": 11, "91": 12, "351": 12, "420": 12}
#: The usual groups of cards, without separators or with one kind of them.
_CARD = re.compile(r"\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)(?:\d{4}(?:(?P=s)\d{1,3})?|\d{1,3})|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{4,5}")


def _ends(m: re.Match) -> list[re.Match]:
    """The match and those of its pattern that end at one of its separators, longest first."""
    out = [m]
    for at in range(m.end() - 1, m.start(), -1):
        if m.string[at] in " .-" and (short := _ALONE[m.re].fullmatch(m.string, m.start(), at)):
            out.append(short)
    return out


def _whole(kind: str, m: re.Match) -> tuple[int, int]:
    """How well the digits of a match make one number: the usual length or groups, then the longer."""
    d = re.sub(r"[\W_]", "", m[0])
    if kind == "iban":
        usual = _IBAN.get(d[:2]) == str(len(d))
    elif kind == "card":
        usual = _CARD.fullmatch(m[0]) is not None
    else:
        usual = any(_PHONE.get(d[:k]) == len(d) for k in (1, 2, 3))
    return usual, len(d)


def _valid(names: Pseudonyms, kind: str, m: re.Match) -> tuple[re.Match, str | None]:
    """The best match from this start that validates, and its pseudonym.

    A number may be followed by others that its pattern takes in. Of the ends that validate, the one
    with the country's length or the usual groups and like separators is taken, else the longest. A
    card without usual groups gives way to one with them that begins later inside.
    """
    how = getattr(names, kind)
    if kind not in ("card", "iban") and not (kind == "phone" and m[0][0] == "+" and m[0][1] != "1"):
        return m, how(m)
    m = _ONE[kind].match(m.string, m.start()) or m
    found = [(_whole(kind, x), x, new) for x in _ends(m) if (new := how(x)) is not None]
    best = max(found, key=lambda x: x[0], default=((False, 0), m, None))
    if kind == "card" and best[2] is not None and not best[0][0]:
        for at in range(m.start() + 1, best[1].end()):
            if m.string[at - 1] == " " and (inner := _ONE[kind].match(m.string, at)) is not None:
                if any(_whole(kind, x)[0] and how(x) is not None for x in _ends(inner)):
                    return m, None
    return best[1:]


_ONE = {name: re.compile(pattern) for name, pattern in KINDS}
#: The same without what must follow: that is a separator where a match is cut short.
_ALONE = {_ONE[name]: re.compile(re.sub(r"\(\?!(?:[^()]|\\.)*\)$", "", pattern)) for name, pattern in KINDS}
_ANY = re.compile("|".join(f"(?P<_{name}>{pattern})" for name, pattern in KINDS))
#: What any of them needs: a digit or an at sign, or one of the words before a secret.
_HINT = re.compile(r"[0-9@]|(?i:pass|secret|token|api)")


def pseudonymized(text: str, names: Pseudonyms) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _HINT.search(text):
        return text, counts
    out, at, start = [], 0, 0
    while (m := _ANY.search(text, start)) is not None:
        kind = m.lastgroup if m.lastgroup and m.lastgroup.startswith("_") else next(k for k, v in m.groupdict().items() if k.startswith("_") and v is not None)
        m, new = _valid(names, kind[1:], m)
        if new is None:  # not that kind: a later kind may still match here
            for other, pattern in _LATER[kind[1:]]:
                if (again := pattern.match(text, m.start())) is not None:
                    again, new = _valid(names, other, again)
                    if new is not None:
                        m, kind = again, f"_{other}"
                        break
        if new is None:
            start = max(m.start() + 1, _run_end(text, m.start()))
            continue
        out += [text[at : m.start()], new]
        at = start = m.end()
        counts[kind[1:]] = counts.get(kind[1:], 0) + 1
    return "".join([*out, text[at:]]), counts


_LATER = {name: [(other, re.compile(pattern)) for other, pattern in KINDS[i + 1 :]] for i, (name, _) in enumerate(KINDS)}
_DIGITS = re.compile(r"\w*")


def _run_end(text: str, at: int) -> int:
    return _DIGITS.match(text, at).end()


def pseudonymize(docs: DataFrame, *, key: bytes, text: str = "text", counted: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text column; with counted, also a column of how many.

    Emails (their local part), secrets after a telling word, access keys and tokens, private keys,
    IBANs, IPv4 and IPv6 addresses, dates (by numbers, and with English names of months), social
    security numbers, payment cards and telephone numbers are found by format, validated (checksums,
    ranges, calendars) and permuted within it by a Feistel network under the caller's key: equal
    values stay equal across documents, valid ones stay valid, and the key's owner can go back.

    Whole texts are read, however long; nothing is shuffled. Null texts stay null, empty ones empty;
    rows, ids and all other columns stay as they are, repeated rows alike, and an empty table stays
    empty. A column named as counted is replaced.
    """
    if counted in docs.columns:
        docs = docs.drop(counted)
    at = docs.columns.index(text)
    added = [] if counted is None else [counted]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        holding("pii")
        names = Pseudonyms(key)
        made = [(None, {}) if t is None else pseudonymized(t, names) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array([t for t, _ in made], batch.column(at).type)
        if added:
            columns.append(pa.array([sum(c.values()) for _, c in made], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    schema = docs.withColumn(counted, F.lit(0).cast("long")).schema if counted else docs.schema
    return map_arrow(docs, run, schema, 512)
