"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Card numbers, account numbers (IBAN), phone numbers (international, national and
local), social security numbers, IP addresses of both versions, dates (by numbers or
with a month's name), e-mail addresses and secrets (tokens of known forms, and what
stands behind words such as token or password) are found and validated: cards by the
Luhn digit, IBANs by their remainder of 97, addresses by their parts, dates by the
calendar. A day has the same pseudonym in every spelling of dates. A value is then permuted among all values of its format
under a secret key: its digits and letters are the digits of a number in mixed
radix, halves of which a Feistel network adds keyed hashes of each other to. What
makes a value valid is kept, so pseudonyms pass the same checks, and a value has
the same pseudonym in every document. With the key, ``restore`` takes it back
(days and months of one digit come back with two, IPv6 letters in one case), by the
places in ``found``.

A card is looked for among the digit groups of a match: in groups as cards have
them first, so an expiry, a CVV or a number beside it doesn't count, then the match
as a whole, then its other runs of groups of three digits or more (shorter ones
are lists of numbers). Where a match fails its check, the other kinds and shorter
and later runs of its groups are tried. Letters of other scripts are permuted
among the letters of their kind in their 128 code points.

Defined results: a null text stays null and an empty one empty; a text without
valid personal data stays as it is, character by character; texts are read whole
at any length; rows with null or repeated ids are treated one by one; an empty
table gives an empty result. Columns other than id and text are ignored by
``pseudonymise``, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 10
#: Where a run's secret is configured; Spark hides settings of such names.
KEY_SETTING = "spark.gridwright.pii.secret"
#: For tests and demonstrations; a real run has a secret of its own.
DEMO_KEY = b"a key that is not secret"
KINDS = ("email", "secret", "iban", "ipv6", "ip", "date", "mdy", "month", "ssn", "card", "phone")
#: Names of months by language; "en3" is the short English form. Fixed values.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en3": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
RESULT = "doc_id bigint, text string, n_found int, found array<struct<kind:string,start:int,end:int,pseudonym:string>>"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Accented letters of Latin-1, small and capital.
_SMALL, _CAPITAL = ("".join(c for c in map(chr, r) if c.isalpha()) for r in (range(0xDF, 0x100), range(0xC0, 0xDF)))
_ALPHABETS = {c: a for a in (_LOWER, _UPPER, _DIGITS, _SMALL, _CAPITAL) for c in a}
_LATIN = frozenset(_ALPHABETS)
#: Groups of digits as cards have them.
_CARD_GROUPS = frozenset([*((n,) for n in range(13, 20)), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)])
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


def _alphabet(c: str) -> str:
    """The characters that ``c`` is permuted among; empty where it stays."""
    if c not in _ALPHABETS:
        kind, page = unicodedata.category(c), ord(c) & ~127
        found = "".join(x for x in map(chr, range(page, page + 128)) if unicodedata.category(x) == kind and x not in _LATIN) if ord(c) > 255 and kind in ("Ll", "Lu", "Lo", "Lt", "Nd") else ""
        _ALPHABETS[c] = found if len(found) > 1 else ""
    return _ALPHABETS[c]


def _round(key: bytes, kind: str, i: int, x: int, sizes: tuple[int, int], modulus: int) -> int:
    """A keyed hash below the modulus, as long as it needs to be."""
    text = f"{kind}|{i}|{sizes}|{x}".encode()
    digest = hashlib.blake2b(text, key=key, digest_size=32).digest()
    for more in range(1, (modulus.bit_length() + 64) // 256 + 1 if modulus.bit_length() > 256 else 0):
        digest += hashlib.blake2b(text + b"|%d" % more, key=key, digest_size=32).digest()
    return int.from_bytes(digest, "big") % modulus


def permute(value: int, a: int, b: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of the numbers below a * b."""
    left, right = divmod(value, b)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            right = (right + sign * _round(key, kind, i, left, (a, b), b)) % b
        else:
            left = (left + sign * _round(key, kind, i, right, (a, b), a)) % a
    return left * b + right


def permute_text(text: str, key: bytes, kind: str, back: bool = False, among: str = "") -> str:
    """Letters and digits permuted within their alphabets (or ``among``), all other characters in their places."""
    own = (lambda c: among if c in among else "") if among else _alphabet
    at = [i for i, c in enumerate(text) if own(c)]
    value, sizes = 0, [1, 1]
    for n, i in enumerate(at):
        alphabet = own(text[i])
        value = value * len(alphabet) + alphabet.index(text[i])
        sizes[2 * n >= len(at)] *= len(alphabet)
    if len(at) > 1:
        value = permute(value, *sizes, key, kind, back)
    elif at:  # one character: a keyed step to another one of its alphabet
        size = sizes[0] * sizes[1]
        step = 1 + _round(key, kind, 0, 0, (1, size), size - 1)
        value = (value + (-step if back else step)) % size
    out = list(text)
    for i in reversed(at):
        value, k = divmod(value, len(own(text[i])))
        out[i] = own(text[i])[k]
    return "".join(out)


def _into(pattern: str, digits: str) -> str:
    """``digits`` in the places that digits have in ``pattern``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _only(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _walk(value: str, key: bytes, kind: str, back: bool, valid: Callable[[str], bool]) -> str:
    """Permute until the result is in the format again: a permutation of the valid values."""
    while True:
        value = permute_text(value, key, kind, back)
        if valid(value):
            return value


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _only(text)
    if len(digits) < 13 or luhn_digit(digits[:-1]) != digits[-1] or digits.count(digits[0]) == len(digits):
        return None
    body = digits[0] + permute_text(digits[1:-1], key, "card", back)  # the first digit is the scheme's
    return _into(text, body + luhn_digit(body))


def _iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00"))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if f"{98 - _iban_rest(country, account) % 97:02d}" != check:
        return None
    account = permute_text(account, key, "iban" + country, back)
    it = iter(country + f"{98 - _iban_rest(country, account) % 97:02d}" + account)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    return _walk(text, key, "ssn", back, valid) if valid(text) else None


def _phone(text: str, key: bytes, back: bool) -> str | None:
    n, local = len(_only(text)), len(text) == 8 and text[3] == "-"
    if not 7 <= n <= (20 if text[0] == "+" else 15):
        return None
    head = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|\(?0*", text)  # the country's code and zeros in front stay
    rest = text[head.end() :]
    if head[0][:1] == "+":
        return head[0] + permute_text(rest, key, "phone", back)
    valid = lambda x: re.match("[2-9]" if local else r"\D*[1-9]", x) is not None
    return head[0] + _walk(rest, key, "local" if local else "phone", back, valid) if valid(rest) else None


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _day(day: datetime.date, key: bytes, back: bool) -> datetime.date | None:
    """The pseudonym of a day among those from 1900 to 2099."""
    n = day.toordinal() - _FIRST_DAY
    if not 0 <= n < _DAYS:
        return None
    n = permute(n, 271, 270, key, "date", back)  # 73,170 numbers hold all days
    while n >= _DAYS:
        n = permute(n, 271, 270, key, "date", back)
    return datetime.date.fromordinal(n + _FIRST_DAY)


def _numbers(text: str, order: tuple[int, int, int], key: bytes, back: bool) -> str | None:
    parts = re.split(r"[-/.]", text)
    try:
        new = _day(datetime.date(*(int(parts[i]) for i in order)), key, back)
    except ValueError:
        return None
    if new is None:
        return None
    for i, x in zip(order, (new.year, new.month, new.day)):
        parts[i] = f"{x:0{len(parts[i])}d}" if len(parts[i]) > 1 else f"{x:02d}"
    return re.search(r"[-/.]", text)[0].join(parts)


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first."""
    return _numbers(text, (0, 1, 2) if text[:4].isdecimal() else (2, 1, 0), key, back)


def _mdy(text: str, key: bytes, back: bool) -> str | None:
    """Month first, where day first gives no date; its pseudonym keeps this order, whatever its day."""
    return _numbers(text, (2, 0, 1), key, back) if back or int(text.split("/")[1]) > 12 else None


def _month(text: str, key: bytes, back: bool, style: str = "") -> tuple[str, str] | None:
    """A date with a month's name: its pseudonym, and the list of names it is written with."""
    found = next(m for m in re.finditer(r"[^\W\d_]+", text) if not re.fullmatch("st|nd|rd|th|of|de", m[0], re.I))
    name, number = found[0], re.compile(r"\d+")
    style = style or next((k for k, names in MONTHS.items() if name.lower() in [x.lower() for x in names]), "")
    day, year = number.findall(text)
    try:
        new = _day(datetime.date(int(year), [x.lower() for x in MONTHS[style]].index(name.lower()) + 1, int(day)), key, back)
    except (ValueError, KeyError):
        return None
    if new is None:
        return None
    other = MONTHS[style][new.month - 1]
    other = other.lower() if name.islower() else other.upper() if name.isupper() else other[0].upper() + other[1:]
    out = text[: found.start()] + "\0" + text[found.end() :]
    out = re.sub(r"(\d{1,2})(st|nd|rd|th)?(?!\d)", lambda m: f"{new.day}{m[2] and ('th' if 10 < new.day < 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(new.day % 10, 'th')) or ''}", out, count=1)
    out = re.sub(r"\d{4}", f"{new.year:04d}", out, count=1)
    return out.replace("\0", other), style


def _ipv6(text: str, key: bytes, back: bool) -> str | None:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if sum(c in string.hexdigits for c in text) < 8:  # 1::2 is more often something else
        return None
    return permute_text(text, key, "ipv6", back, "0123456789ABCDEF") if text.upper() == text else permute_text(text.lower(), key, "ipv6", back, "0123456789abcdef")


def _secret(text: str, key: bytes, back: bool) -> str | None:
    """Labels and the prefixes of known forms stay; hexadecimal values stay hexadecimal."""
    head = _SECRET_HEAD.match(text).end()
    value = text[head:]
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return None
    among = next((x for x in ("0123456789abcdef", "0123456789ABCDEF") if not set(value) - set(x)), "")
    return text[:head] + permute_text(value, key, "secret", back, among)


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    return permute_text(name, key, "email", back) + "@" + host


_NAMES = "|".join(sorted({x for names in MONTHS.values() for x in names}, key=len, reverse=True))
_SECRET_HEAD = re.compile(r"""(?i:[\w-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?)|Bearer |AKIA|ASIA|gh[pousr]_|sk-|sk_(?:live|test)_|xox[abprs]-|AIza|eyJ|""")
_FIND = {
    "email": r"[^\W_][\w.+-]*@(?:[^\W_](?:[^\W_]|-)*\.)+[^\W\d_]{2,}",
    "secret": r"""(?<!\w)(?i:[\w-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?)[^\s"',;<>]{4,}|(?<!\w)(?:Bearer [\w.~+/-]{16,}=*|sk-[\w-]{20,})(?![\w-])|(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?!\w)""",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "ip": r"(?<![\w.])(?<!\bver )(?<!\b[vV]ersion )\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?!(?!T\d)\w|[/-]|\.\d)",
    "mdy": r"(?<![\w./-])\d{1,2}/\d{1,2}/\d{4}(?!(?!T\d)\w|[/-]|\.\d)",
    "month": rf"(?<![\w.])(?:\d{{1,2}}(?:st|nd|rd|th|\.)? (?:of |de )?(?i:{_NAMES})\.?,? (?:de )?\d{{4}}|(?i:{_NAMES})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<=SSN )\d{3} \d{2} \d{4}(?![\w-])|(?<=SSN: )\d{3} \d{2} \d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)",
    "phone": r"(?<![\w.])(?:(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,7}|\(0\d{1,4}\) ?\d{2,8}(?:[ -]\d{2,5}){0,3}|0[1-9]\d{1,3}[ /-]\d{5,8}|0[1-9](?:[ .-]\d{2}){4}|(?<!\d )[2-9]\d{2} [2-9]\d{2} \d{4}(?! \d)|0[1-9]\d{1,3}(?:[ /-]\d{2,4}){2,4}|(?<!-)\d{3}-\d{4}(?!-)|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _FIND.items()))
_MAYBE = re.compile("[0-9@]")
_CHANGES = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "ipv6": _ipv6, "date": _date, "mdy": _mdy}


def change(kind: str, text: str, key: bytes, back: bool) -> tuple[str, str] | None:
    """The kind (with the way a date is written, as in ``month:de``) and pseudonym of a value; None if it is not valid."""
    if kind.startswith("month"):
        new = _month(text, key, back, kind.partition(":")[2])
        return new and (f"month:{new[1]}", new[0])
    new = _CHANGES[kind](text, key, back)
    return None if new is None else (kind, new)


_EACH = {k: re.compile(p) for k, p in _FIND.items()}
_GROUP = re.compile(r"\w+")


def _runs(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The runs of digit groups between two places that can be a card: those with a card's groups, and others."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    usual, other = [], []
    for i in range(len(groups)):
        sizes: tuple[int, ...] = ()
        for low, high in groups[i:]:
            if not text[low:high].isdecimal() or sum(sizes) + high - low > 19:
                break
            sizes += (high - low,)
            if sizes in _CARD_GROUPS:
                usual.append((groups[i][0], high))
            elif sum(sizes) >= 13 and min(sizes) >= 3 and re.fullmatch(r"\d+(?:[ -]\d+)*", text[groups[i][0] : high]):
                other.append((groups[i][0], high))
    usual = [r for r in usual if re.fullmatch(r"\d+(?:[ -]\d+)*", text[slice(*r)])]
    return usual, sorted(other, key=lambda r: (r[0], -r[1]))


def _inside(text: str, start: int, end: int, kinds: tuple[str, ...], key: bytes, back: bool) -> tuple[str, int, int, str] | None:
    """The first valid value of some kinds that begins at a group between two places, at its longest, and ends there."""
    groups = [m.span() for m in re.finditer(r"[+(]?\w[\w./]*", text[start:end])]
    for low, _ in groups:
        for kind in kinds:
            m = _EACH[kind].match(text, start + low)
            ends = [start + high for at, high in reversed(groups) if at >= low] if kind in ("iban", "phone") else []
            for stop in [m.end()] if m and m.end() <= end else []:
                if new := change(kind, m[0], key, back):
                    return new[0], start + low, stop, new[1]
            for stop in ends if m else []:
                part = _EACH[kind].fullmatch(text, start + low, stop)
                if part and (new := change(kind, part[0], key, back)):
                    return new[0], start + low, stop, new[1]
    return None


def _values(text: str, m: re.Match, again: bool, key: bytes, back: bool) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of the valid values in a match, in their order; ``again`` if a match that began earlier has failed."""
    start, end, kind = m.start(), m.end(), m.lastgroup
    usual, other = _runs(text, start, end) if kind in ("card", "iban", "phone") else ([], [])
    whole = [(kind, start, end)]
    card = lambda runs: [("card", *r) for r in runs]
    tried = card(usual) + whole * (not again) + card(other) if kind == "card" else whole
    for k, low, high in tried:
        if new := change(k, text[low:high], key, back):
            return [*_others(text, start, low, key, back), (new[0], low, high, new[1])]
    part = _others(text, start, end, key, back)
    if not part and kind != "card":
        for k, low, high in card(usual + other):
            if new := change(k, text[low:high], key, back):
                return [(new[0], low, high, new[1])]
    return part


def _others(text: str, start: int, end: int, key: bytes, back: bool) -> list[tuple[str, int, int, str]]:
    """Valid values of other kinds than cards between two places."""
    found = []
    while start < end and (one := _inside(text, start, end, ("iban", "ipv6", "ip", "date", "mdy", "month", "ssn", "phone"), key, back)):
        found.append(one)
        start = one[2]
    return found


def pseudonymise_text(text: str, key: bytes = DEMO_KEY, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms in the place of personal data, and what was replaced where."""
    if not _MAYBE.search(text):
        return text, []
    out, found, end, at, again = [], [], 0, 0, 0  # again: where the last match that failed ended
    while m := _PATTERN.search(text, at):
        values = _values(text, m, m.start() < again, key, back)
        for kind, low, high, new in values:
            out += [text[end:low], new]
            found.append({"kind": kind, "start": low, "end": high, "pseudonym": new})
            end = high
        if values:
            at = end
        else:  # a value may begin at a later group and go on behind the match
            later = re.compile(r"[ -]").search(text, m.start(), m.end())
            at, again = later.end() if later else m.end(), max(again, m.end())
    return "".join([*out, text[end:]]) if found else text, found


def restore_text(text: str, found: list[dict], key: bytes = DEMO_KEY) -> tuple[str, list[dict]]:
    """The original of a text with pseudonyms, by what was replaced where."""
    out, back, end, shift = [], [], 0, 0
    for f in found:
        low = f["start"] + shift
        high = low + len(f["pseudonym"])
        old = change(f["kind"], text[low:high], key, True)[1]
        out += [text[end:low], old]
        back.append({"kind": f["kind"], "start": low, "end": high, "pseudonym": old})
        shift += high - low - (f["end"] - f["start"])
        end = high
    return "".join([*out, text[end:]]), back


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False) -> DataFrame:
    """RESULT for each row of (doc_id, text); start and end are code points of the original text."""
    known = back and "found" in docs.columns
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if known:
                done = [(None, []) if x is None else restore_text(x, f or [], key) for x, f in zip(batch["text"].to_pylist(), batch["found"].to_pylist())]
            else:
                done = [(None, []) if x is None else pseudonymise_text(x, key, back) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int32()), pa.array([f for _, f in done], found_type)],
                names=["doc_id", "text", "n_found", "found"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["found"] if known else [])).mapInArrow(run, RESULT)


def configured_key(spark: SparkSession) -> bytes:
    """The secret in KEY_SETTING, or the key for demonstrations where none is set."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY.decode()).encode()


def restore(pseudonyms: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """The original texts, with the key."""
    return pseudonymise(pseudonyms, key, back=True)
