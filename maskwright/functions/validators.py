"""Checksum and shape validators.

Each validator is a Spark SQL expression over a string expression (built-ins only, so Catalyst
inlines it); ``column(name, c)`` wraps one as a Column for a whole column of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import IP_EXCLUDED

# Check-digit weights and the sign-up e-mail rule.
BSN_WEIGHTS = [9, 8, 7, 6, 5, 4, 3, 2, -1]
CNP_WEIGHTS = [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]
EMAIL_RULE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def _with(value: str, name: str, body: str) -> str:
    """``let name = value in body`` for expressions."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _weighted(d: str, weights: list[int]) -> str:
    return " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * ({w})" for i, w in enumerate(weights))


def iban_sql(v: str) -> str:
    """Length 15–34, shape, and the letters-as-numbers remainder by 97 equal to 1."""
    letters = "(r * 100 + ascii(ch) - 55) % 97"
    number = "(r * 10 + CAST(ch AS INT)) % 97"
    remainder = (
        "aggregate(split(concat(substr(s, 5), substr(s, 1, 4)), ''), 0, "
        f"(r, ch) -> IF(ch BETWEEN 'A' AND 'Z', {letters}, {number}))"
    )
    shaped = "length(s) BETWEEN 15 AND 34 AND s RLIKE '^[A-Z]{2}[0-9]{2}[A-Z0-9]+$'"
    return _with(f"upper(regexp_replace({v}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', ''))", "s", f"coalesce(IF({shaped}, {remainder} = 1, false), false)")


def card_sql(v: str) -> str:
    return _with(
        f"regexp_replace({v}, '[\\\\s-]', '')",
        "s",
        "coalesce(IF(s RLIKE '^[0-9]{13,19}$', luhn_check(s), false), false)",
    )


def bsn_sql(v: str) -> str:
    total = _weighted("d", BSN_WEIGHTS)
    return _with(_digits(v), "d", f"coalesce(IF(length(d) = 9, ({total}) > 0 AND ({total}) % 11 = 0, false), false)")


def cpr_sql(v: str) -> str:
    day, month = "CAST(substr(d, 1, 2) AS INT)", "CAST(substr(d, 3, 2) AS INT)"
    ok = f"{day} BETWEEN 1 AND 31 AND {month} BETWEEN 1 AND 12"
    return _with(_digits(v), "d", f"coalesce(IF(length(d) = 10, {ok}, false), false)")


def personnummer_sql(v: str) -> str:
    return _with(_digits(v), "d", "coalesce(IF(length(d) IN (10, 12), luhn_check(right(d, 10)), false), false)")


def cnp_sql(v: str) -> str:
    rest = f"({_weighted('d', CNP_WEIGHTS)}) % 11"
    check = f"IF({rest} = 10, 1, {rest}) = CAST(substr(d, 13, 1) AS INT)"
    return _with(_digits(v), "d", f"coalesce(IF(length(d) = 13, {check}, false), false)")


def phone_sql(v: str) -> str:
    return f"coalesce(length({_digits(v)}) BETWEEN 8 AND 15, false)"


def email_format_sql(v: str) -> str:
    rule = EMAIL_RULE.replace("\\", "\\\\")
    return f"coalesce({v} RLIKE '{rule}', false)"


def ip_sql(v: str) -> str:
    return f"{v} NOT IN ({', '.join(repr(x) for x in IP_EXCLUDED)})"


CHECKS_SQL = {
    "phone": phone_sql,
    "iban": iban_sql,
    "card": card_sql,
    "bsn": bsn_sql,
    "cpr": cpr_sql,
    "personnummer": personnummer_sql,
    "cnp": cnp_sql,
    "ip": ip_sql,
    "email_format": email_format_sql,
}


def column(name: str, c: str) -> Column:
    """Validator ``name`` over the column or expression text ``c``."""
    return F.expr(CHECKS_SQL[name](c))
