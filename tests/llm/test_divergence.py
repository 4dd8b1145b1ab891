"""Source divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from maskwright.llm import divergence
from maskwright.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows):
    """Rows (lang, source, text), every group against every term."""
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = terms_of(text)
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for x, s in count if x == lang]
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        own, whole = {s: p(count[lang, s]) for s in sources}, p(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            telling = [(f(own[s][t], whole[t]), t) for t in kept if count[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, items, top in (("pair", pairs, None), ("term", telling, 200)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "über", "überall", "ÜBER", "naïve", "x" * 40, "x" * 41, "日本", "日本語"]
    words = stems + [s.upper() for s in stems] + ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for _ in range(160):
        text = rng.choice([" ", "-", "7", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["de", "en", "", None, "Ω"]), rng.choice(["a", "b", "c", "", None, "é"]), rng.choice([text, text, text, None])))
    return rows + [("lone", "a", "z1 z2"), ("lone", "b", None), ("single", "a", "w w w"), ("single", "a", "w"), ("single", "a", "w v")]


def test_levels_count_distinct_documents():
    """Per prefix, rows that are new at a level add up to the documents that hold it."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aaaaaaab") for _ in range(rng.choice([2, 9, 16, 17, 33]))) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    for level, size in enumerate(divergence.FIRST_LEVEL << i for i in range(3)):
        got, want = Counter(), Counter()
        for t in texts:
            want.update({w[:size] for w in t.encode().split() if len(w) >= size})
            for new_at, terms in divergence.new_terms(t.encode().split()):
                got.update(term[:size] for term in terms if len(term) >= size and new_at <= level)
        assert got == want and want
    for n in range(70):
        assert divergence.level_of(b"a" * n, b"a" * n + b"b") == next(i for i in range(9) if divergence.FIRST_LEVEL << i > n)


def test_refinement_keeps_exactly_the_frequent_terms(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    kept = {(bytes(r.lang).decode(), bytes(r.term).decode()) for r in divergence.refined(divergence.counted(docs)).collect()}
    held = Counter((lang or "", t) for lang, _, text in rows for t in set(terms_of(text)))
    assert kept == {k for k, n in held.items() if n >= 3} and len(kept) < len(held)


def test_matches_brute_force(spark):
    for seed in (2, 3):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "item long, lang string, source string, text string, value int")
        assert sorted(map(tuple, divergence.audit(docs.repartition(4)).collect())) == brute(rows)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    parts = list(divergence._count(iter([divergence.pa.RecordBatch.from_pylist([{"l": b"x", "s": b"y", "t": b"a b c d e f g h a"}] * 5)])))
    assert len(parts) > 1
    assert sum(sum(map(sum, b.column(4).to_pylist())) for b in parts) == 45


def test_large_counts_are_exact(spark):
    n, total, terms = 10**12 + 1, 3 * 10**13 + 7, 10**6
    got = spark.range(1).select(divergence._probability(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + terms)
    got = spark.range(1).select(divergence._probability(F.lit(10**9 - 1), F.lit(10**9), F.lit(3)).alias("p")).first().p
    assert got == 1 + 10**9 * 10**9 // (10**9 + 3)
    p, q = 10**9 + 1, 3
    assert spark.range(1).select(divergence._term_value(F.lit(p).cast("long"), F.lit(q).cast("long")).alias("f")).first().f == (p - q) ** 2 // q


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([("de", "a", "x Y")] * 3 + [("de", "b", None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == brute([tuple(r) for r in docs.collect()])
    assert divergence.audit(docs.where(F.lit(False))).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_source_divergence"](spark, sf).collect())) == brute(rows)
