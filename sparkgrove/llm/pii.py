"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits,
scheme marks and cue words of identifiers. Deterministic local parsers expand from each
anchor and validate what they find. Base kinds follow the patterns of the contract,
leftmost and not overlapping within a kind; a match that fails its check is dropped and
its text consumed. Further kinds add spans and never remove any:

``telephone``   after a plus sign, where too many digits follow for a base phone: up to the
                last space that leaves 9 to 15 digits
``number``      a card number among others: a part without spaces, of 13 to 19 digits that
                pass Luhn, of a run that is no base card
``mailbox``     an email whose name part goes on in letters that are not ASCII
``login``       user and password in a URL, ``scheme://user:password@``
``iban``        an account number that passes its mod-97 check, in its country's length
                if that passes, else in the greatest length that does
``identifier``  a number after a cue such as ``ssn`` or ``passport``, with five digits
                in its first 20 characters, to its end; past those a part after a space
                belongs to it if it holds a digit
``secret``      a value of 16 or more characters after a cue such as ``token =``
``address``     an address with a scheme, its host a dotted name or an IP address and its
                port in range; without the signs of the sentence that follow it

Offsets are code points, end exclusive. Defined results: null and empty texts have no
spans. Repeated rows get a row each. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, table

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("telephone", "number", "mailbox", "login", "iban", "identifier", "secret", "address")
_KINDS = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
#: Cue words (lower case) and what they announce.
CUES = {
    "identifier": ("ssn", "social security", "passport", "national id", "tax id", "account number", "account no", "acct"),
    "secret": ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd", "access_key", "private_key"),
    "iban": ("iban",),
}
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9](?:-?[0-9])*")
_DIGITS = re.compile(r"[0-9]+")
_LOGIN = re.compile(r"([^\s/@:]+):([^\s/@]+)@")
_AFTER = re.compile(r"(?:\s+(?:number|no|nr|id|is))?\.?\s*[:=#]?\s*[\"']?")
_NUMBER = re.compile(r"[0-9A-Z](?:[ -]?[0-9A-Z]){4,19}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an account number by country.
_IBAN_LENGTHS = {
    text[:2]: int(text[2:])
    for text in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 "
        "NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_MORE = re.compile(r"[0-9A-Z]*+(?:-[0-9A-Z]++| (?=[A-Z]*+[0-9])[0-9A-Z]++)*+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_HOST = re.compile(r"(?:[^\s/?#@\"'<>]*+@)?(?:\[([0-9A-Fa-f:.]++)\]|([\w.-]++))(?::([0-9]++))?")
_PATH = re.compile(r"(?:[/?#][^\s\"'<>]*+)?")
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+.]{16,})")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, "#" if sign.isdigit() else sign)
    found.add_word("://", ":")
    for kind, words in CUES.items():
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


def _email(text: str, at: int, free: int) -> Span | None:
    """Around the at-sign at ``at``, from ``free`` on."""
    start = at
    while start > free and text[start - 1] in _NAME:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return ("email", start, domain.end()) if domain and start < at else None


def _is_octet(digits: str) -> bool:
    """At most 255, with any number of zeros in front."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) < 256


def _is_host(name: str) -> bool:
    """A dotted name, or four numbers of an IP address."""
    parts = name.removesuffix(".").split(".")
    if parts[-1].isdecimal():
        return bool(_IP.fullmatch(name)) and all(map(_is_octet, parts))
    return len(parts) > 1 and all(0 < len(x) < 64 and x[0] != "-" != x[-1] for x in parts)


def _is_ipv6(name: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(name))
    except ValueError:
        return False


def _address(text: str, at: int, free: int) -> Span | None:
    """Around the ``://`` at ``at``, from ``free`` on."""
    start = at
    while start > free and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    m = _HOST.match(text, at + 3)
    if start == at or not m or m[3] and (len(m[3]) > 5 or int(m[3]) > 65535) or not (_is_ipv6(m[1]) if m[1] else _is_host(m[2].rstrip("."))):
        return None
    end = _PATH.match(text, m.end()).end()
    open_brackets = text.count("(", at, end) - text.count(")", at, end)
    while text[end - 1] in ".,;:!?*" or text[end - 1] == ")" and open_brackets < 0:
        end -= 1
        open_brackets += text[end] == ")"
    return ("address", start, end)


def _lowered(text: str) -> str:
    """Lower case that keeps every offset."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str | None, automaton) -> list[Span]:
    """All spans of a text, by kind as listed, then by start."""
    found: list[Span] = []
    if not text:
        return found
    ends = dict.fromkeys(_KINDS, 0)
    for last, what in automaton.iter(_lowered(text)):
        if what == "#":
            if last >= ends["ip"]:
                if m := _IP.match(text, last):
                    ends["ip"] = m.end()
                    if all(map(_is_octet, m[0].split("."))):
                        found.append(("ip", last, m.end()))
                else:  # nor from any later digit of this run
                    ends["ip"] = _DIGITS.match(text, last).end()
            if last >= ends["card"] and (m := _CARD.match(text, last)):
                ends["card"] = m.end()
                if _is_card(m[0]):
                    found.append(("card", last, m.end()))
                else:
                    found += [("number", last + part.start(), last + part.end()) for part in _PART.finditer(m[0]) if _is_card(part[0])]
        elif what == "@":
            if span := _email(text, last, ends["email"]):
                found.append(span)
                ends["email"] = span[2]
                start = span[1]
                while start and (text[start - 1].isalnum() or text[start - 1] in _NAME):
                    start -= 1
                if start < span[1] and start >= ends["mailbox"]:
                    found.append(("mailbox", start, span[2]))
                    ends["mailbox"] = span[2]
        elif what == "+":
            if last >= ends["phone"] and (m := _PHONE.match(text, last)):
                ends["phone"] = m.end()
                if 9 <= len(_digits_of(m[0])) <= 15:
                    found.append(("phone", last, m.end()))
                elif end := _phone_end(text, last, m.end()):
                    found.append(("telephone", last, end))
        elif what == ":":
            if m := _LOGIN.match(text, last + 1):
                found.append(("login", m.start(), m.end() - 1))
            if span := _address(text, last - 2, ends["address"]):
                found.append(span)
                ends["address"] = span[2]
        elif last + 1 >= ends[what] and (span := _announced(what, text, last + 1)):
            found.append(span)
            ends[what] = span[2]
    return sorted(set(found), key=lambda s: (_KINDS[s[0]], s[1], s[2]))


def _digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_end(text: str, start: int, end: int) -> int:
    """Where the digits before a space last count 9 to 15 in a longer run; 0 if nowhere."""
    n, at, found = 0, start, 0
    for i in range(start, end):
        if text[i] == " " and 9 <= n <= 15:
            found = at
        elif text[i].isdigit():
            n, at = n + 1, i + 1
            if n > 15:
                break
    return found


def _announced(kind: str, text: str, at: int) -> Span | None:
    """What follows a cue that ends at ``at``."""
    if kind == "secret":
        m = _SECRET.match(text, at)
        return (kind, *m.span(1)) if m else None
    start = _AFTER.match(text, at).end()
    if kind == "iban":
        m = _IBAN.match(text, start)
        end = next((end for end in _iban_ends(m[0]) if mod97(m[0][:end])), 0) if m else 0
        return (kind, start, start + end) if end else None
    m = _NUMBER.match(text, start)
    return (kind, start, _MORE.match(text, m.end()).end()) if m and len(_digits_of(m[0])) >= 5 else None


def _iban_ends(text: str) -> list[int]:
    """Where an account number at the start may end: its country's length, then the
    longest first."""
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    n = _IBAN_LENGTHS.get(text[:2], 0)
    whole = [end for end in ends[:13:-1] if end == len(text) or text[end] == " "]
    return ends[n - 1 : n] * (n > 0) + whole


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` → the id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    for kind in BASE_KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in (part for b in batches for part in pieces(b, 1)):
            rows = [spans(t.as_py(), automaton) for t in batch.column(1)]
            base = [[s for s in row if s[0] in BASE_KINDS] for row in rows]
            counts = [pa.array([sum(s[0] == kind for s in row) for row in base], pa.int64()) for kind in BASE_KINDS]
            digests = pa.array([hashlib.sha256(joined(row).encode()).hexdigest() for row in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(map(joined, rows), pa.string()), pa.array(map(len, rows), pa.int64())], names=schema.names)

    return in_arrow(docs.select(id_col, text_col), run, schema)


def redacted(text: str, found: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlaps become one."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
