"""DuckDB side of detection: the same catalogue, evaluated relationally.

Matches are unnested with their index, offsets come from the lengths of the pieces before them,
validators are WHERE conditions, and overlaps are resolved by a list fold.
"""

from __future__ import annotations

from maskwright.functions.patterns import (
    BLANK,
    CUSTOM_ORD,
    DEFAULT_RULES,
    IP_EXCLUDED,
    PACKS,
    PLACEHOLDER_OTHER,
    PLACEHOLDERS,
)
from maskwright.functions.validators import BSN_WEIGHTS, CNP_WEIGHTS
from maskwright.sources.golden import CORPUS_SQL


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _digits(v):
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _weighted(d, weights):
    return " + ".join(f"TRY_CAST(substr({d}, {i + 1}, 1) AS INT) * ({w})" for i, w in enumerate(weights))


def luhn(d):
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda n: CASE WHEN n % 2 = 1 THEN CAST(reverse({d})[n] AS INT) "
        f"ELSE CAST(substr('0246813579', CAST(reverse({d})[n] AS INT) + 1, 1) AS INT) END)) % 10 = 0)"
    )


def iban(v):
    s = f"upper(regexp_replace({v}, '\\s+', '', 'g'))"
    digits = (
        f"list_transform(string_split({s}[5:] || {s}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ord(c) - 55 END)"
    )
    mod = f"list_reduce(list_prepend(0, {digits}), lambda r, d: CASE WHEN d >= 10 THEN (r * 100 + d) % 97 ELSE (r * 10 + d) % 97 END)"
    return (
        f"(CASE WHEN length({s}) BETWEEN 15 AND 34 AND regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') THEN {mod} = 1 ELSE false END)"
    )


def card(v):
    s = f"regexp_replace({v}, '[\\s-]', '', 'g')"
    return f"(CASE WHEN regexp_full_match({s}, '[0-9]{{13,19}}') THEN {luhn(s)} ELSE false END)"


def bsn(v):
    d = _digits(v)
    t = f"({_weighted(d, BSN_WEIGHTS)})"
    return f"(CASE WHEN length({d}) = 9 THEN {t} > 0 AND {t} % 11 = 0 ELSE false END)"


def cpr(v):
    d = _digits(v)
    return (
        f"(CASE WHEN length({d}) = 10 THEN TRY_CAST(substr({d},1,2) AS INT) BETWEEN 1 AND 31 AND TRY_CAST(substr({d},3,2) AS INT) BETWEEN 1 AND 12 ELSE false END)"
    )


def personnummer(v):
    d = _digits(v)
    return f"(CASE WHEN length({d}) IN (10, 12) THEN {luhn(f'right({d}, 10)')} ELSE false END)"


def cnp(v):
    d = _digits(v)
    r = f"(({_weighted(d, CNP_WEIGHTS)}) % 11)"
    return f"(CASE WHEN length({d}) = 13 THEN CASE WHEN {r} = 10 THEN 1 ELSE {r} END = CAST(substr({d},13,1) AS INT) ELSE false END)"


def phone(v):
    return f"(length({_digits(v)}) BETWEEN 8 AND 15)"


def ip(v):
    return f"({v} NOT IN ({', '.join(q(x) for x in IP_EXCLUDED)}))"


CHECKS = {"phone": phone, "iban": iban, "card": card, "bsn": bsn, "cpr": cpr, "personnummer": personnummer, "cnp": cnp, "ip": ip}


def raw_cte(corpus: str, key: str, types=None, pack="server", text="text") -> dict[str, str]:
    """CTEs ``corpus`` and ``sp``: every valid span before overlap resolution."""
    chosen = [d for d in PACKS[pack] if types is None or d.type in types]
    parts = []
    for d in chosen:
        ok = CHECKS[d.check]("v[i]") if d.check else "true"
        parts.append(
            f"SELECT {key}, {d.ord} AS ord, {q(d.type)} AS type, {q(d.country)} AS country, "
            "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS s, v[i] AS v "
            f"FROM (SELECT {key}, v, g, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, {q(d.pattern)}) AS v, "
            f"regexp_split_to_array({text}, {q(d.pattern)}) AS g FROM corpus) WHERE len(v) > 0) WHERE {ok}"
        )
    return {
        "corpus": corpus,
        "sp": f"SELECT {key}, ord, type, country, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e, v FROM (" + " UNION ALL ".join(parts) + ")",
    }


def fold(name: str, source: str, key: str) -> dict[str, str]:
    """CTEs giving ``name``: overlap-free spans of ``source`` in long form."""
    one = "{'s': s, 'e': e, 'ord': ord, 'type': type, 'country': country, 'v': v}"
    keep = (
        "list_reduce(l, lambda a, x: CASE WHEN x.s >= a.e THEN {'s': a.s, 'e': x.e, 'out': list_concat(a.out, x.out)} ELSE a END)"
    )
    return {
        f"{name}_l": f"SELECT {key}, list({{'s': s, 'e': e, 'out': [{one}]}} ORDER BY s, ord) AS l FROM {source} GROUP BY {key}",
        name: f"SELECT {key}, m.s AS s, m.e AS e, m.ord AS ord, m.type AS type, m.country AS country, m.v AS v FROM (SELECT {key}, unnest(r.out) AS m FROM (SELECT {key}, {keep} AS r FROM {name}_l))",
    }


def term_cte(key: str, terms: str, source: str = "corpus", text: str = "text") -> dict[str, str]:
    """CTE ``cu``: custom-term spans. ``terms`` is a list expression over ``source``."""
    low = f"lower({text})"
    return {
        "cu": f"""SELECT {key}, {CUSTOM_ORD} + ti - 1 AS ord, 'CUSTOM_TERM' AS type, CAST(NULL AS VARCHAR) AS country,
      CAST(s AS BIGINT) AS s, CAST(s + length(term) AS BIGINT) AS e, substr({text}, s + 1, length(term)) AS v
      FROM (SELECT {key}, {text}, term, ti, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(term) AS s
        FROM (SELECT {key}, {text}, term, ti, g, unnest(range(1, len(g))) AS i
          FROM (SELECT {key}, {text}, term, ti, string_split({low}, lower(term)) AS g
            FROM (SELECT {key}, {text}, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS ti FROM (SELECT *, {terms} AS terms FROM {source}))
            WHERE term <> '')))"""
    }


SEEDED = CORPUS_SQL


def action_sql(types: str, rules: dict[str, str] | None = None) -> str:
    """Action from a list-of-types expression."""
    rules = DEFAULT_RULES if rules is None else rules
    has = lambda a: f"len(list_intersect({types}, [{', '.join(q(t) for t, x in rules.items() if x == a) or 'NULL'}])) > 0"
    return f"CASE WHEN {has('BLOCK')} THEN 'BLOCK' WHEN {has('WARN')} THEN 'WARN' ELSE 'ALLOW' END"


def placeholder_sql(type_: str) -> str:
    return f"CASE {type_} " + " ".join(f"WHEN {q(t)} THEN {q(p)}" for t, p in PLACEHOLDERS.items()) + f" ELSE {q(PLACEHOLDER_OTHER)} END"


REPLACE = {
    "tag": placeholder_sql("type"),
    "blank": q(BLANK),
    "hash": "'[' || type || ':' || sha256(v)[:8] || ']'",
}


def redact_cte(name: str, spans: str, key: str, mode: str = "tag") -> dict[str, str]:
    """CTE ``name(key, redacted)`` from disjoint spans: gap + replacement per span, then the tail."""
    return {
        name: f"""SELECT c.{key}, coalesce(r.body || substr(c.text, r.last + 1), c.text) AS redacted FROM corpus c LEFT JOIN (
      SELECT {key}, string_agg(piece, '' ORDER BY s) AS body, max(e) AS last FROM (
        SELECT p.{key}, p.s, p.e, substr(c2.text, p.prev + 1, p.s - p.prev) || p.rep AS piece FROM (
          SELECT {key}, s, e, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS prev, {REPLACE[mode]} AS rep FROM {spans}) p
        JOIN corpus c2 ON c2.{key} = p.{key}) GROUP BY {key}) r ON r.{key} = c.{key}"""
    }
