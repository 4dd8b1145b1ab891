"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import periods
from maskwright.llm.queries import QUERIES


def brute_runs(words):
    """Every maximal stretch, period by period; one whose smallest period is less is left out."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *strongest, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def periodic_words(rng, n, vocabulary):
    """Words with copies of stretches, periods within periods, and single changes."""
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.5:
            unit = [rng.randrange(vocabulary) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.4:
                unit = unit[:3] * rng.randint(1, 12) + unit[3:5]
            words += (unit * rng.randint(2, 9))[: rng.randint(20, 300)]
        else:
            words += [rng.randrange(vocabulary) for _ in range(rng.randint(1, 60))]
    for _ in range(rng.randint(0, 3)):
        words[rng.randrange(len(words))] = rng.randrange(vocabulary)
    return words[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng, rng.randint(0, 900), rng.choice([1, 2, 3, 50])) for _ in range(40)]
    texts += [[0] * 700, [0, 1] * 300, ([0] * 30 + [1]) * 9, [], [5], [0] * 23, [0] * 24, list(range(8)) * 3, list(range(9)) * 3 + [0, 1]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.array([w for t in texts for w in t], np.int64)
    want = [brute_runs(t) for t in texts]
    assert periods.find_runs(ids, offsets) == want
    assert sum(map(len, want)) > 60
    # a hash that calls everything equal: the words decide
    assert periods.find_runs(ids, offsets, base=0) == want


def test_long_blocks_in_windows(monkeypatch):
    monkeypatch.setattr(periods, "LONGEST_BLOCK", 16)
    monkeypatch.setattr(periods, "NUMBERS_AT_ONCE", 64)
    rng = random.Random(9)
    texts = [periodic_words(rng, 700, 3) for _ in range(8)]
    unit = [rng.randrange(1000) for _ in range(170)]
    texts += [unit * 3 + unit[:50], [1] + unit * 4 + [2]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert periods.find_runs(np.array([w for t in texts for w in t], np.int64), offsets) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("size", [32, 64, 128, 2048])
def test_convolution_is_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(0, periods.PRIME, (2, size))
    got = periods.transform(periods._reduce(periods.transform(a[None].astype(float)) * periods.transform(b[None].astype(float))), True)
    want = [sum(int(a[i]) * int(b[(k - i) % size]) for i in range(size)) * size % periods.PRIME for k in range(size)]
    assert (got[0].astype(np.int64) % periods.PRIME).tolist() == want


def test_a_document_of_many_scales():
    rng = random.Random(3)
    unit = [rng.randrange(10**6) for _ in range(9000)]
    words = [-1] + unit * 3 + [7] * 5000
    offsets = np.array([0, len(words)])
    ids = np.unique(np.array(words), return_inverse=True)[1]
    assert periods.find_runs(ids, offsets) == [[(1, 27000, 9000), (27001, 5000, 1)]]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    short = [d for d in docs if len(d.text or "") < 30000]  # brute force is quadratic; longer ones are tested above
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert {d.doc_id: got[d.doc_id] for d in short} == {d.doc_id: brute_row(d.doc_id, d.text) for d in short}
    assert sum(1 for r in got.values() if r[0]) > 5


def test_odd_rows(spark):
    twice = "a b c d " * 40
    rows = [(1, None, "x"), (2, "", "x"), (3, "\t\n ", "x"), (None, twice, "x"), (4, twice, "x"), (4, twice, "x"), (5, "é é " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periods string")
    got = [r.periods for r in periods.collapse(docs).orderBy("doc_id").collect()]
    assert [(g.n_words, len(g.runs), g.collapsed) for g in got] == [
        (160, 1, "a b c d"), (0, 0, ""), (0, 0, ""), (0, 0, ""), (160, 1, "a b c d"), (160, 1, "a b c d"), (30, 1, "é é"),
    ]
    assert periods.collapse(docs.where(F.lit(False))).count() == 0
    assert periods.digest(periods.collapse(periods.repeated_tail(docs))).count() == len(rows)
