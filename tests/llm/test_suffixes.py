"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from maskwright.llm import suffixes
from maskwright.llm.suffixes import LENGTH


def brute(texts):
    places = defaultdict(list)
    bodies = [(t or "").encode() for t in texts]
    for i, b in enumerate(bodies):
        for s in range(len(b) - LENGTH + 1):
            places[b[s : s + LENGTH]].append((i, s))
    marks = [bytearray(len(b)) for b in bodies]
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                marks[i][s : s + LENGTH] = b"\1" * LENGTH
    out = []
    for b, m in zip(bodies, marks):
        kept = bytes(c for c, x in zip(b, m) if not x)
        runs = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out.append((len(b), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(90), prose(160)
    texts = [None, "", "short", prose(30), base, base, base[:-1], base[1:], "x" * 1500, "ab" * 700, ("abc " * 60), shared]
    for _ in range(25):
        texts.append(prose(rng.randint(5, 60)) + shared + prose(rng.randint(5, 60)))
        cut = rng.randint(0, len(base) - 1)
        texts.append(base[:cut] + rng.choice("xyz") + base[cut + rng.randint(0, 2) :])
    for size in (199, 200, 201):
        texts += [shared[:size], prose(3) + shared[7 : 7 + size] + prose(3)]
    return texts


@pytest.mark.parametrize("limits", [(100_000, 20_000), (3, 2)])
def test_matches_brute_force(spark, limits):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    rows = suffixes.remove(docs, in_bucket=limits[0], classes=limits[1]).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BYTES_AT_ONCE", 300)
    texts = corpus()
    for t in texts[:40]:
        body = (t or "").encode()
        pieces = [p for parts, _, _ in suffixes._chunks([body]) for p in parts]
        assert sum(max(0, len(p) - LENGTH + 1) for p in pieces) == max(0, len(body) - LENGTH + 1)


def test_null_ids_repeated_rows_empty_table(spark):
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    docs = spark.createDataFrame([(None, t), (None, t), (1, t[:250]), (1, t[:250]), (2, "a")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove(docs).collect())
    assert got == [(1, 0), (250, 250), (250, 250), (500, 500), (500, 500)]
    assert suffixes.remove(docs.where(F.lit(False))).count() == 0


def test_ids_of_any_type_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BYTES_AT_ONCE", 700)  # texts in several pieces
    texts = corpus()
    ids = [("same" if i % 3 else f"d{i}") for i in range(len(texts))]
    docs = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(zip(ids, texts))], "doc_id string, text string, place int").repartition(4)
    for limits in ((100_000, 20_000), (3, 2)):
        got = sorted(tuple(r)[1:4] + (r.kept_sha256,) for r in suffixes.remove(docs, in_bucket=limits[0], classes=limits[1]).collect())
        assert got == sorted(brute(texts))
