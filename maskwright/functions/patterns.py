"""Detector catalogue: which pattern belongs to which type, in tie-break order.

Patterns are written once, in the portable dialect (ASCII ``\\b``). ``java_regex`` turns the
word boundary into ASCII look-arounds, because the JVM's own ``\\b`` is Unicode-aware and would
miss an identifier that touches an accented letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --------------------------------------------------------------------------------------
# Type order (= tie-break order), patterns, placeholders, default actions.
# --------------------------------------------------------------------------------------
EMAIL = [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"]

PHONE = [
    r"\+\d{1,3}[\s.\-]?\(?\d{1,5}\)?[\s.\-]?\d{2,5}[\s.\-]?\d{2,5}[\s.\-]?\d{0,5}",
    r"\(\d{2,5}\)\s*\d{3,5}[\s.\-]?\d{3,5}",
    r"\b0\d{1,3}[\s.\-]?\d{3,5}[\s.\-]?\d{3,5}\b",
]

IBAN = [r"\b[A-Za-z]{2}[0-9]{2}(?:\s?[A-Za-z0-9]{4}){2,7}(?:\s?[A-Za-z0-9]{1,4})?\b"]

CREDIT_CARD = [r"\b(?:\d{4}[\s\-]?){3,4}\d{1,4}\b"]

STREET = (
    r"(?i)\b\d{1,5}\s+[A-Za-z]+\s+"
    r"(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl)\b"
)
UK_POSTCODE = r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
DUTCH_POSTCODE = r"\b\d{4}\s?[A-Z]{2}\b"

ADDRESS = [
    STREET,
    UK_POSTCODE,
    r"\b[1-9]\d{3}\s+[A-ZÆØÅ][a-zæøå]+",
    r"\b[0-9]{5}\s+[A-ZÄÖÜ][a-zäöüß]+",
    DUTCH_POSTCODE,
]

ADDRESS_CLIENT = [
    STREET,
    r"\b\d{5}(?:-\d{4})?\b",
    UK_POSTCODE,
    r"\b[1-9]\d{3}\s+[A-ZÆØÅÀ-ÿ][a-zæøåà-ÿ]+",
    r"\b[0-9]{5}\s+[A-ZÄÖÜÀ-ÿ][a-zäöüßà-ÿ]+",
    DUTCH_POSTCODE,
    r"\b\d{3}\s\d{2}\b",
    r"\b[0-9]{4}\s+[A-ZÆØÅÀ-ÿ][a-zæøåà-ÿ]{2,}\b",
]

PASSWORD = [
    r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S+",
    r"(?i)\b(api[_\-]?key|apikey)\s*[:=]\s*\S+",
    r"(?i)\b(secret|token|access_token|auth_token)\s*[:=]\s*\S+",
    r"(?i)\b(2fa|totp|otp|mfa)\s*[:=]?\s*\d{6,8}\b",
    r"\bsk[-_]live[-_][a-zA-Z0-9]{24,}\b",
    r"\bsk[-_]test[-_][a-zA-Z0-9]{24,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
    r"\bghp_[a-zA-Z0-9]{36}\b",
    r"\bgho_[a-zA-Z0-9]{36}\b",
    r"\bghs_[a-zA-Z0-9]{36}\b",
    r"\bglpat-[a-zA-Z0-9\-_]{20,}\b",
    r"\bxoxb-[0-9]+-[a-zA-Z0-9-]+\b",
    r"\bxoxp-[0-9]+-[a-zA-Z0-9-]+\b",
    r"\bBearer\s+[a-zA-Z0-9._\-]{20,}\b",
]

# country -> pattern
NATIONAL_ID = {
    "DK": r"\b\d{6}-\d{4}\b",
    "SE": r"\b\d{6}[-+]\d{4}\b",
    "FI": r"\b\d{6}[+\-A]\d{3}[0-9A-FHJK-NPR-Y]\b",
    "NO": r"\b\d{2}[01]\d[0-9]\d{2}\d{5}\b",
    "ES": r"\b\d{8}[A-HJ-NP-TV-Z]\b",
    "NL": r"\b[1-9]\d{8}\b",
    "FR": r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b",
    "IT": r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
    "PL": r"\b\d{11}\b",
    "RO": r"\b[1-9]\d{12}\b",
    "PT": r"\b[125689]\d{8}\b",
    "BE": r"\b\d{2}[.\-]\d{2}[.\-]\d{2}[.\-]\d{3}[.\-]\d{2}\b",
    "AT": r"\b\d{4}\s\d{6}\b",
    "GR": r"\b[1-9]\d{8}\b",
}

VAT = [
    r"\b(AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|GB|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK)U?\d{2,12}\b"
]

IP_ADDRESS = [r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"]
IP_EXCLUDED = ["127.0.0.1", "0.0.0.0", "255.255.255.255"]

DATE_OF_BIRTH = [
    r"(?i)\b(dob|date of birth|born on|born:?|birthday)\s*[:=]?\s*"
    r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{2}[\/\-\.]\d{2})"
]

CUSTOM_TERM = "CUSTOM_TERM"

PLACEHOLDERS = {
    "EMAIL": "[EMAIL]",
    "PHONE": "[PHONE]",
    "IBAN": "[IBAN]",
    "CREDIT_CARD": "[CARD]",
    "ADDRESS": "[ADDRESS]",
    "PASSWORD": "[SECRET]",
    "NATIONAL_ID": "[NATIONAL_ID]",
    "VAT": "[VAT]",
    "IP_ADDRESS": "[IP_ADDRESS]",
    "DATE_OF_BIRTH": "[DOB]",
    "CUSTOM_TERM": "[REDACTED]",
}
PLACEHOLDER_OTHER = "[REDACTED]"
BLANK = "████████"

DEFAULT_RULES = {
    "EMAIL": "WARN",
    "PHONE": "WARN",
    "IBAN": "BLOCK",
    "CREDIT_CARD": "BLOCK",
    "ADDRESS": "WARN",
    "PASSWORD": "BLOCK",
    "NATIONAL_ID": "BLOCK",
    "VAT": "WARN",
    "IP_ADDRESS": "WARN",
    "DATE_OF_BIRTH": "WARN",
    "CUSTOM_TERM": "WARN",
}
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """One pattern of one type. ``ord`` decides ties between matches with the same start."""

    type: str
    ord: int
    pattern: str
    check: str | None = None  # validator name, see validators.CHECKS
    country: str | None = None
    gate: str | None = None  # word that must occur in the text, see spans.gate_sql
    shape: str | None = None  # pattern that must occur in the text's digit contexts

    @property
    def jvm(self) -> str:
        return EMAIL_JVM if self.type == "EMAIL" else java_regex(self.pattern)


# An e-mail can only start at the first character of a run of local-part characters, or where the
# previous match ended; saying so keeps the search linear on long unbroken runs (base64, hashes).
_LOCAL = r"[a-zA-Z0-9._%+-]"
EMAIL_JVM = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"


def _family(type_, base, patterns, check=None, gates=None, shapes=None):
    none = [None] * len(patterns)
    return [
        Detector(type_, base + i, p, check, gate=g, shape=h)
        for i, (p, g, h) in enumerate(zip(patterns, gates or none, shapes or none))
    ]


_ID_CHECKS = {"DK": "cpr", "SE": "personnummer", "NL": "bsn", "RO": "cnp"}
_SECRET_GATES = [
    "pass", "api", "secret", "otp", "live", "test", "AKIA", "ghp_", "gho_", "ghs_", "glpat-", "xox", "xox", "Bearer",
]

# Digit contexts: every digit of a text with the digits that follow (each after at most one
# separator or two letters) and the letters behind. Texts are mostly prose, so the contexts are
# short, and the shapes below are tested on them instead of on the whole text. The loop is
# possessive: it neither backtracks nor recurses on long digit runs.
DIGIT_CONTEXT = r"[0-9](?:[\s.+-]?[0-9]|\s*[A-Za-zÀ-ÿ]{1,2}[0-9])*+(?:\s*[A-Za-zÀ-ÿ]{1,2})?"

# What each detector needs to see in a digit context: its pattern without boundaries, shortened
# where a context could cut it.
_ID_SHAPES = {
    "DK": "[0-9]{6}-[0-9]{4}",
    "SE": "[0-9]{6}[-+][0-9]{4}",
    "FI": "[0-9]{6}[-+A][0-9]{3}",
    "NO": "[0-9]{12}",
    "ES": "[0-9]{8}[A-Z]",
    "NL": "[0-9]{9}",
    "FR": r"[0-9](?:\s?[0-9]){14}",
    "IT": "[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]",
    "PL": "[0-9]{11}",
    "RO": "[0-9]{13}",
    "PT": "[0-9]{9}",
    "BE": r"[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}[.-][0-9]{3}[.-][0-9]{2}",
    "AT": r"[0-9]{4}\s[0-9]{6}",
    "GR": "[0-9]{9}",
}
_PHONE_SHAPE = r"0[0-9](?:[\s.-]?[0-9]){6}"
_CARD_SHAPE = r"[0-9](?:[\s-]?[0-9]){12}"
_STREET_SHAPE = r"[0-9]\s+[A-Za-z]"
_UK_SHAPE = "[0-9][A-Za-z]{2}"
_DUTCH_SHAPE = r"[0-9]{4}\s?[A-Z]{2}"
_CITY4, _CITY5 = r"[0-9]{4}\s+[A-ZÀ-ÿ]", r"[0-9]{5}\s+[A-ZÀ-ÿ]"
_IP_SHAPE = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"


def _server():
    ids = [Detector("NATIONAL_ID", 700 + i, p, _ID_CHECKS.get(c), c, shape=_ID_SHAPES[c]) for i, (c, p) in enumerate(NATIONAL_ID.items())]
    address = [_STREET_SHAPE, _UK_SHAPE, _CITY4, _CITY5, _DUTCH_SHAPE]
    return (
        _family("EMAIL", 100, EMAIL, gates=["@"])
        + _family("PHONE", 200, PHONE, "phone", ["+", "(", None], [None, None, _PHONE_SHAPE])
        + _family("IBAN", 300, IBAN, "iban", gates=["letdig"])
        + _family("CREDIT_CARD", 400, CREDIT_CARD, "card", shapes=[_CARD_SHAPE])
        + _family("ADDRESS", 500, ADDRESS, shapes=address)
        + _family("PASSWORD", 600, PASSWORD, gates=_SECRET_GATES)
        + ids
        + _family("VAT", 800, VAT, gates=["capdig"])
        + _family("IP_ADDRESS", 900, IP_ADDRESS, "ip", shapes=[_IP_SHAPE])
        + _family("DATE_OF_BIRTH", 1000, DATE_OF_BIRTH, gates=["birth"])
    )


def _client():
    shapes = [_STREET_SHAPE, "[0-9]{5}", _UK_SHAPE, _CITY4, _CITY5, _DUTCH_SHAPE, r"[0-9]{3}\s[0-9]{2}", _CITY4]
    address = _family("ADDRESS", 500, ADDRESS_CLIENT, shapes=shapes)
    kept = {"EMAIL", "PHONE", "IBAN", "CREDIT_CARD", "PASSWORD"}
    return sorted([d for d in _server() if d.type in kept] + address, key=lambda d: d.ord)


PACKS = {"server": _server(), "client": _client()}
TYPES = {name: list(dict.fromkeys(d.type for d in pack)) for name, pack in PACKS.items()}
CUSTOM_ORD = 10000

_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def java_regex(pattern: str) -> str:
    """Same language as ``pattern`` under ASCII word boundaries, for ``java.util.regex``.

    Every leading ``\\b`` is followed by a word character, so it is just "no word character
    before"; a trailing ``\\b`` after a certain word character is "no word character after".
    """
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    head = tail = ""
    if body.startswith(r"\b"):
        body = body[2:]
        head = first_class(body) + r"(?<!\w)"
    if body.endswith(r"\b"):
        body = body[:-2]
        tail = r"(?!\w)" if ends_in_word_char(body) else _ASCII_BOUNDARY
    return flags + head + body.replace(r"\b", _ASCII_BOUNDARY) + tail


def first_class(body: str) -> str:
    """Look-ahead for the character class a pattern starts with, '' if it starts otherwise.

    It changes nothing in what matches, but the engine then rejects most positions on one
    character test instead of on a look-behind.
    """
    start = body.removeprefix("(?:")
    if start.startswith(r"\d"):
        return r"(?=\d)"
    if start.startswith("["):
        return f"(?={start[: start.index(']') + 1]})"
    return ""


def ends_in_word_char(body: str) -> bool:
    """True when the last atom can only match ASCII letters, digits or underscore."""
    atom = re.sub(r"(\{[\d,]+\}|[+?*])$", "", body)
    if atom.endswith(r"\d"):
        return True
    last_class = re.search(r"\[([^\[\]]*)\]$", atom)
    if last_class:
        return re.fullmatch(r"(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9])+", last_class.group(1)) is not None
    return atom.endswith((")", "]")) and re.search(r"[A-Za-z\dd?}]\)$", atom) is not None
