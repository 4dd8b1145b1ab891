"""Detectors on golden texts, client pack assertions, gates, offsets, overlaps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans
from maskwright.functions.patterns import PACKS, java_regex
from maskwright.sources.golden import GOLDEN

# case number -> expected (type, start, end)
EXPECTED = {
    1: [("EMAIL", 5, 18)], 2: [("PHONE", 5, 20)], 3: [("PHONE", 5, 19)], 4: [("PHONE", 5, 18)], 5: [("IBAN", 6, 33)],
    6: [], 7: [("CREDIT_CARD", 6, 25)], 8: [], 9: [("ADDRESS", 3, 14)], 10: [("ADDRESS", 10, 18)],
    11: [("ADDRESS", 6, 20)], 12: [("ADDRESS", 9, 21)], 13: [("ADDRESS", 9, 16)], 14: [("PASSWORD", 8, 32)],
    15: [("PASSWORD", 0, 11)], 16: [("PASSWORD", 0, 15)], 17: [("PASSWORD", 0, 10)], 18: [("PASSWORD", 0, 32)],
    19: [("PASSWORD", 0, 32)], 20: [("PASSWORD", 7, 27)], 21: [("PASSWORD", 0, 40)], 22: [("PASSWORD", 0, 40)],
    23: [("PASSWORD", 0, 40)], 24: [("PASSWORD", 0, 27)], 25: [("PASSWORD", 0, 24)], 26: [("PASSWORD", 0, 24)],
    27: [("PASSWORD", 0, 31)], 28: [("NATIONAL_ID", 4, 15)], 29: [("NATIONAL_ID", 4, 15)], 30: [("NATIONAL_ID", 4, 15)],
    31: [("NATIONAL_ID", 5, 16)], 32: [("NATIONAL_ID", 3, 15)], 33: [("NATIONAL_ID", 4, 13)], 34: [("NATIONAL_ID", 4, 13)],
    35: [("NATIONAL_ID", 6, 27)], 36: [("NATIONAL_ID", 3, 19)], 37: [("NATIONAL_ID", 6, 17)], 38: [("NATIONAL_ID", 4, 17)],
    39: [("NATIONAL_ID", 4, 13)], 40: [("NATIONAL_ID", 5, 20)], 41: [("NATIONAL_ID", 5, 16)], 42: [("VAT", 4, 15)],
    43: [("IP_ADDRESS", 5, 20)], 44: [], 45: [("DATE_OF_BIRTH", 0, 15)], 46: [("DATE_OF_BIRTH", 0, 18)], 47: [],
    48: [("NATIONAL_ID", 1, 10)], 49: [], 50: [("EMAIL", 0, 7), ("EMAIL", 12, 19)],
    51: [("IBAN", 5, 27), ("CREDIT_CARD", 34, 53), ("EMAIL", 60, 67)], 52: [("PHONE", 13, 28)], 53: [("PHONE", 5, 16)],
    54: [], 55: [("NATIONAL_ID", 12, 23)], 56: [("ADDRESS", 9, 20)], 57: [], 58: [],
}

# client pack: text -> (types that must be found, types that must not)
CLIENT = [
    ("contact me at john@example.com please", ["EMAIL"], []),
    ("email: user@mail.example.co.uk", ["EMAIL"], []),
    ("this is not an email", [], ["EMAIL"]),
    ("call me at (555) 123-4567", ["PHONE"], []),
    ("my number is +1-555-123-4567", ["PHONE"], []),
    ("the code is 1234", [], ["PHONE"]),
    ("Number: +45 12 34 56 78", ["PHONE"], []),
    ("+4512345678", ["PHONE"], []),
    ("Invoice ID: 20230915001", [], ["PHONE"]),
    ("password=SuperSecret123!", ["PASSWORD"], []),
    ("postnummer 111 22 Stockholm", ["ADDRESS"], []),
    ("adresse: 0150 Oslo", ["ADDRESS"], []),
    ("IBAN DE89370400440532013000", ["IBAN"], []),
    ("IBAN DE89370400440532013001", [], ["IBAN"]),
    ("Hello, how are you today?", [], ["EMAIL", "PHONE", "IBAN", "ADDRESS", "PASSWORD"]),
]


def found(df, **kw):
    rows = spans.with_matches(df, **kw).select("id", "text", "matches").collect()
    return {r.id: r for r in rows}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(list(enumerate(GOLDEN, 1)), "id int, text string")


def test_golden_spans(golden):
    assert len(GOLDEN) == len(EXPECTED) == 58
    for i, r in found(golden).items():
        assert [(m.type, m.start, m.end) for m in r.matches] == EXPECTED[i], (i, r.text)
        for m in r.matches:
            assert r.text[m.start : m.end] == m.value


def test_column_form_equals_staged_form(golden):
    one = {r.id: r.m for r in golden.select("id", spans.detect("text").alias("m")).collect()}
    for i, r in found(golden).items():
        assert one[i] == r.matches


def test_client_pack(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLIENT)], "id int, text string")
    for i, r in found(df, pack="client").items():
        types = {m.type for m in r.matches}
        assert set(CLIENT[i][1]) <= types and not set(CLIENT[i][2]) & types, (CLIENT[i], types)


def test_only_an_explicit_false_disables():
    assert "EMAIL" in spans.enabled_types("client", {"PHONE": True})
    assert "EMAIL" not in spans.enabled_types("client", {"EMAIL": False})
    assert spans.enabled_types("client", None) is None


def test_null_and_empty_text_are_clean(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert all(r.matches == [] for r in found(df).values())


def _noise(rng):
    pieces = list(GOLDEN) + ["12", "1234", " ", "-", ".", "A1", "AB", "é", "+", "(", ")", "5A12", "\n", "0", "99 Zürich", "x_y", "=", ": "]
    return rng.choice(["", " ", ""]).join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))


def test_gates_never_change_the_result(spark):
    rng = random.Random(7)
    alphabet = "0123456789" * 3 + " .-+/:=()_@\t" + "ABCKWZabkwz" + "éÅ"
    texts = [_noise(rng) for _ in range(1500)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    for pack in ("server", "client"):
        gated = {r.id: r.raw for r in spans.with_raw_and_matches(df, pack=pack).collect()}
        plain = {r.id: r.raw for r in spans.with_raw_and_matches(df, pack=pack, gated=False).collect()}
        wrong = [texts[i] for i in plain if gated[i] != plain[i]]
        assert not wrong, wrong[:3]


def test_spans_against_python_re(spark):
    """Offsets and boundaries against an independent engine with ASCII classes."""
    rng = random.Random(11)
    texts = [_noise(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    unchecked = [d for d in PACKS["server"] if d.check is None]
    got = {r.id: r.raw for r in spans.with_raw_and_matches(df).collect()}
    for i, t in enumerate(texts):
        for d in unchecked:
            want = [(m.start(), m.end()) for m in re.finditer(d.pattern, t, re.ASCII)]
            have = [(m.start, m.end) for m in got[i] if m.ord == d.ord]
            assert have == want, (d, t)


def test_boundary_rewrite_keeps_open_tails():
    assert java_regex(r"\bglpat-[a-zA-Z0-9\-_]{20,}\b").endswith(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    assert java_regex(r"\b\d{11}\b") == r"(?=\d)(?<!\w)\d{11}(?!\w)"


def test_resolved_spans_are_disjoint_and_greedy(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, _noise(rng)) for i in range(300)], "id int, text string")
    for r in spans.with_raw_and_matches(df).collect():
        want, last = [], -1
        for m in sorted(r.raw, key=lambda m: (m.start, m.ord)):
            if m.start >= last:
                want.append(m)
                last = m.end
        assert r.matches == want


def test_custom_terms(spark):
    df = spark.createDataFrame(
        [(1, "Widget WIDGETwidget", ["widget", "", None]), (2, "a.b a+b \\E x", ["a.b", "\\E"]), (3, "x", None)],
        "id int, text string, terms array<string>",
    )
    out = {r.id: r.m for r in df.select("id", F.expr(spans.terms_sql("text", "terms")).alias("m")).collect()}
    assert [(m.start, m.end, m.value) for m in out[1]] == [(0, 6, "Widget"), (7, 13, "WIDGET"), (13, 19, "widget")]
    assert [(m.start, m.end) for m in out[2]] == [(0, 3), (8, 10)]
    assert out[3] == []


def test_long_runs_do_not_blow_up(spark):
    """Unbroken digit, letter and base64-like runs stay linear and need no deep stack."""
    texts = ["1" * 300_000, "a" * 300_000 + "@", ("ab1" * 100_000) + " x@y.com", "1 " * 100_000, ("a@b.co " * 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    out = {r.id: r.n for r in spans.with_matches(df).select("id", F.size("matches").alias("n")).collect()}
    assert out[2] == 1 and out[4] == 2000 and out[0] == 0
