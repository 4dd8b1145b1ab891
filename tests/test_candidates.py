"""Candidates of the validators: whole groups, overlapping, against enumeration."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import validators
from maskwright.functions.candidates import SHAPES, candidates

JOBS = {"iban": "iban_valid", "card": "card_valid", "bsn": "bsn_valid", "cpr": "cpr_valid", "personnummer": "personnummer_valid", "cnp": "cnp_valid", "phone": "phone_digits_valid"}


def valid_ones(spark, kind, text):
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(candidates(kind, F.col("text"))).alias("value"))
    return sorted(r.value for r in df.where(validators.column(kind, "value")).distinct().collect())


def enumerated(kind, text):
    """All stretches between any two places, by Python's own patterns."""
    shape, out = SHAPES[kind], []
    group = "[A-Za-z0-9]+" if shape.account else "[0-9]+"
    first = "[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]*" if shape.account else group
    whole = re.compile(f"{first}(?:{shape.parts}{group})*")
    alone = lambda i: not (0 < i < len(text) and re.match("[A-Za-z0-9]{2}", text[i - 1 : i + 1]))
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 4 * shape.most) + 1):
            w = text[i:j]
            if alone(i) and alone(j) and whole.fullmatch(w) and shape.least <= len(re.sub("[^A-Za-z0-9]", "", w)) <= shape.most:
                out.append(w)
    return sorted(out)


@pytest.mark.parametrize(
    "kind,text,found",
    [
        ("iban", "pay GB82 WEST 1234 5698 7654 32 and call", "GB82 WEST 1234 5698 7654 32"),
        ("iban", "NL91 ABNA 0417 1643 00", "NL91 ABNA 0417 1643 00"),
        ("iban", "to DE89 3704 0044 0532 0130 00 12 pieces", "DE89 3704 0044 0532 0130 00"),
        ("iban", "de89370400440532013000.", "de89370400440532013000"),
        ("card", "2024 4111111111111111", "4111111111111111"),
        ("card", "4111-1111-1111-1111 12 27", "4111-1111-1111-1111"),
        ("bsn", "bsn 111.222.333, 7", "111.222.333"),
    ],
)
def test_found_next_to_others(spark, kind, text, found):
    assert found in valid_ones(spark, kind, text)


@pytest.mark.parametrize("kind,text", [("iban", "xGB82WEST12345698765432"), ("card", "4111111111111111x 4111111111111112"), ("bsn", "a111222333")])
def test_parts_of_words_are_none(spark, kind, text):
    assert valid_ones(spark, kind, text) == []


def test_against_enumeration(spark):
    rng = random.Random(6)
    pieces = ["12", "345678", "4111111111111111", "GB82", "WEST", "ab", "x9", "1234", "NL91ABNA0417164300", "7"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "-", ".", " (", ") ", "/", "  ", "+", "é", ""]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts += ["", "1 " * 80, "12-" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, text string")
    for kind in SHAPES:
        got = {r.i: sorted(r.c) for r in df.select("i", candidates(kind, F.col("text")).alias("c")).collect()}
        assert got == {i: enumerated(kind, t) for i, t in enumerate(texts)} | {-1: []}, kind


def test_queries_find_valid_ones(spark, sf):
    import __spark_entry__ as entry

    for kind in ("iban", "card"):
        assert entry.queries()[JOBS[kind]](spark, sf).where("valid").count() > 0
