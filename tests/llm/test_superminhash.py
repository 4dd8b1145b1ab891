"""SuperMinHash near-dedup against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import superminhash
from maskwright.llm.queries import QUERIES
from maskwright.llm.superminhash import Forest, registers


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; ids may be null or repeated."""
    sets = [shingles(t) for _, t in rows]
    forest = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                forest.join(i, j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[forest.find(i)] = min(doc_id, names.get(forest.find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        name = names.get(forest.find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), name, not sets[i] or (doc_id is not None and doc_id == name)))
    return sorted(out, key=repr)


def corpus(seed, vocabulary=40):
    """Chains of small changes, templates that many share, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(vocabulary)}é"
    texts = [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "two one"]
    template = [word() for _ in range(50)]
    for _ in range(12):
        t = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(t))
            t = list(t)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = word()
        texts.append(" ".join(template + [word() for _ in range(rng.randint(5, 60))]))
    texts += [texts[20]] * 5
    rng.shuffle(texts)
    return texts


def direct_superminhash(hashes, size):
    """The method step by step, one shingle after the other."""
    values = [2**64 - 1] * size
    for h in hashes:
        p = list(range(size))
        for j in range(size):
            z = int(superminhash._mixed(np.array([(h + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((z & 0xFFFFFFFF) * (size - j) >> 32)
            p[j], p[k] = p[k], p[j]
            values[p[j]] = min(values[p[j]], j << 32 | z >> 32)
    return values


def test_registers_equal_the_method_without_stopping():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 40, 300]
    hashes = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in sizes]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    got = registers(np.concatenate(hashes), owner, len(sizes), 32)
    for i, h in enumerate(hashes):
        assert got[i].tolist() == direct_superminhash(h.tolist(), 32)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**64, 120, dtype=np.uint64)
        a, b = pool[:100], pool[20:]  # 80 of 120
        sig = registers(np.concatenate([a, b]), np.repeat([0, 1], 100), 2)
        errors.append(float((sig[0] == sig[1]).mean()) - 80 / 120)
    assert abs(np.mean(errors)) < 0.015
    assert np.var(errors) < 0.9 * (80 / 120) * (40 / 120) / 128


@pytest.mark.parametrize("seed,most", [(1, 1024), (2, 4)])
def test_matches_brute_force(spark, seed, most):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(corpus(seed))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    got = superminhash.groups(docs, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert len({r.component_id for r in got}) < len(rows) - 15


def test_tiles_meet_every_pair_of_groups(spark):
    """Buckets of many groups, far larger than a tile: every pair of different groups meets."""
    n = 90
    root = [0 if i < 50 else i for i in range(n)]
    rows = [(7, i, root[i], 10) for i in range(n)] + [(8, i, root[i], 10) for i in range(48, 52)] + [(9, i, 0, 10) for i in range(40)]
    tiles = {}
    for r in superminhash.tiled(spark.createDataFrame(rows, "k long, node long, root long, n long"), 8).collect():
        tiles.setdefault(r.g, set()).add(r.node)
    met = {(i, j) for t in tiles.values() for i in t for j in t if i < j}
    assert met >= {(i, j) for i in range(n) for j in range(i + 1, n) if root[i] != root[j]}
    assert len(tiles) > 20 and max(map(len, tiles.values())) < 30


def test_likely_pairs_are_a_forest(spark):
    n = 90
    sig = np.full(128, 7, "<u2").tobytes()
    nodes = spark.createDataFrame([(i, 0 if i < 50 else i, 10, sig) for i in range(n)], "node long, root long, n long, sig binary")
    for most in (8, 256):
        forest = Forest()
        for r in superminhash.further_pairs(nodes, most).collect():
            assert r.ra != r.rb
            forest.join(r.ra, r.rb)
        assert {forest.find(0 if i < 50 else i) for i in range(n)} == {0}


def test_likeliest_pairs_first():
    """A centre that all resemble most becomes the hub."""
    i, j = map(np.array, zip(*[(a, b) for a in range(6) for b in range(a + 1, 6)]))
    weight = np.array([100 if 3 in (a, b) else 80 for a, b in zip(i, j)])
    used = superminhash.spanning(i, j, weight, np.arange(6))
    assert len(used) == 5 and (weight[used] == 100).all()


def test_families_that_are_not_one_group(spark):
    """Copies that resemble a centre and each other by less than it takes; the rest is settled by whole sets."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.sample(range(120), rng.choice([6, 8, 10, 12])):
            t[k] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (6, 256):
        assert sorted(map(tuple, superminhash.groups(docs, most=most).collect()), key=repr) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "x y z u v w"), (2, "a b c d e f g"), (3, "X y z u v w"), (None, "a b c d e f g"), (None, None), (4, None), (None, "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, superminhash.groups(docs).collect()), key=repr) == brute(rows)
    assert superminhash.groups(docs.where(F.lit(False))).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_superminhash"](spark, sf).collect()), key=repr)
    assert got == brute(rows)
    assert any(not r[3] for r in got)
