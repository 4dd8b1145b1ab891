"""Candidates for the validators: every stretch of a text that has the shape of one kind of number.

A shape says which groups of letters and digits may follow one another, what parts them, and how many
characters they hold together. A run is a longest sequence of such groups; a candidate is any part of a
run that begins and ends with whole groups and has the right length, so a card behind a year and an
account before other numbers are found, and candidates overlap. Groups stand alone: a letter or digit
next to one is part of it. A run of n groups gives at most n times the greatest length candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Number of letters and digits, what parts groups of digits, and whether an account's letters occur."""

    least: int
    most: int
    parts: str
    account: bool = False

    @property
    def run(self) -> str:
        """Pattern of a run, or, for accounts, of all that may follow a first group from one place on."""
        if self.account:
            return rf"(?<![A-Za-z0-9])(?=([A-Za-z]{{2}}[0-9]{{2}}[A-Za-z0-9]*+(?:{self.parts}[A-Za-z0-9]++){{0,{self.most}}}))"
        return rf"((?<![A-Za-z0-9])[0-9]+(?:{self.parts}[0-9]+)*(?![A-Za-z0-9]))"


# Lengths that the validators accept, and the separators in use.
SHAPES = {
    "iban": Shape(15, 34, "[ ]", account=True),
    "card": Shape(13, 19, "[ -]"),
    "bsn": Shape(9, 9, "[ .-]"),
    "cpr": Shape(10, 10, "[ -]"),
    "personnummer": Shape(10, 12, "[ +-]"),
    "cnp": Shape(13, 13, "[ -]"),
    "phone": Shape(8, 15, "[ ./()-]{1,3}"),
}


def candidates(kind: str, text: Column) -> Column:
    """Array of the candidates of a kind in a text; a candidate that stands there twice is listed twice."""
    shape = SHAPES[kind]
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shape.run), F.lit(1))
    size = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z0-9]", ""))

    def parts_of(run: Column) -> Column:
        # groups and what parts them alternate; a part of a run is n groups from the i-th on
        pieces = F.regexp_extract_all(run, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
        begins = F.lit(0) if shape.account else (F.size(pieces) - 1) / 2
        windows = lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(shape.most), ((F.size(pieces) + 1) / 2).cast("int") - i)),
            lambda n: F.array_join(F.slice(pieces, 2 * i + 1, 2 * n - 1), ""),
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), begins.cast("int")), windows))

    return F.filter(F.flatten(F.transform(runs, parts_of)), lambda w: size(w).between(shape.least, shape.most))
