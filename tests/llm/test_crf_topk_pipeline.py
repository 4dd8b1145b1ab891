"""The language field and the search against brute force; the pipeline against its stages' definitions."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from maskwright.llm import bpe, crf, rules, topk
from tests.llm.test_text_operators import brute_components, brute_fingerprint, brute_lines, words


# --- conditional random field --------------------------------------------------------------


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    k, sizes = 3, [1, 4, 6, 2]
    emission, transition, start = rng.normal(size=(sum(sizes), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    begins = np.zeros(sum(sizes), bool)
    begins[np.cumsum([0, *sizes[:-1]])] = True
    got, pairs = crf.marginals(emission, begins, transition, start)
    want, want_pairs, at = np.zeros_like(emission), np.zeros((k, k)), 0
    for n in sizes:
        total, part, both = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for labels in itertools.product(range(k), repeat=n):
            s = start[labels[0]] + sum(emission[at + i, x] for i, x in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:]))
            w = np.exp(s)
            total += w
            for i, x in enumerate(labels):
                part[i, x] += w
            for a, b in zip(labels, labels[1:]):
                both[a, b] += w
        want[at : at + n] = part / total
        want_pairs += both / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_blocks_do_not_change_marginals(n, monkeypatch):
    rng = np.random.default_rng(n)
    emission, transition, start = 3 * rng.normal(size=(n, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    begins = rng.random(n) < 0.05
    begins[0] = True
    one = crf.marginals(emission, begins, transition, start)[0]
    monkeypatch.setattr(crf, "BLOCK", 7)
    assert np.allclose(one, crf.marginals(emission, begins, transition, start)[0])


@pytest.fixture(scope="module")
def model(spark):
    return crf.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), per_language=120)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 1500 AND 4000").where(crf.held_out(F.col("doc_id"))).collect()}
    parts = [(lang, " ".join(docs[lang].split()[20:70])) for lang in ("de", "es", "en")]
    both = " ".join(t for _, t in parts)
    found, marginal = crf.label_batch(pa.array([both]), model)
    label = [model.languages[i] for i in marginal.argmax(axis=1)]
    gold = [lang for lang, t in parts for _ in t.split()]
    assert len(label) == len(gold) and sum(a == b for a, b in zip(label, gold)) / len(gold) > 0.85


def test_language_edges(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "en"), (None, "the and of that", None), (5, "x" * 200_000, "de"), (6, "the and of that " * 9000, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, held_out string")
    got = {r.doc_id: r for r in crf.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[None].held_out is False
    assert got[6].lang_pred == got[None].lang_pred == "en" and sum(r.n_words for r in got[6].runs) == 36_000
    assert crf.predict(docs.where("false"), model).count() == 0
    empty = crf.learn(docs.where("false"))
    assert {r.lang_pred for r in crf.predict(docs, empty).collect()} == {"und"}


# --- top-k ---------------------------------------------------------------------------------


def brute_topk(rows, queries, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in usable:
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(topk, "BLOCKS_AT_ONCE", 2)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(400)] + [(400 + i, [1.0] * 24) for i in range(30)]
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 24), (504, [float("inf")] * 24), (None, [1.0] * 24), (505, [3.0, -2.0]), (506, [9.0] * 30)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string").repartition(6)
    asked = table.where("vec_id % 25 = 0 OR vec_id >= 500")
    got = {}
    for r in topk.search(table, asked, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_topk(rows, {i for i, _ in rows if i is not None and (i % 25 == 0 or i >= 500)}, 5)
    assert {q: [(b, c) for _, b, c in sorted(v)] for q, v in got.items()} == want
    assert topk.search(table.where("false"), asked.where("false")).count() == 0
    few = table.where("vec_id < 3")
    assert topk.search(few, few).count() == 6


def test_large_components_and_repeated_rows(spark):
    long = 2**63
    vectors = {
        0: [1e30, 1.0], 1: [1e30, 2.0], 2: [-1e30, 0.0], 3: [2.0**40, 2.0**22], 4: [2.0**22, -(2.0**40)], 5: [1.0, 1.0],
        6: [2.0**21, 2.0**21], 7: [2.0**23, 1.0], 8: [-(2.0**23), 3.0],
    }
    rows = list(vectors.items()) + [(9, [0.5, 0.5]), (9, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.search(table, table, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    near = lambda x: min(max(x, -long), long - 1)
    whole = [(i, [near(int(256 * x)) for x in v]) for i, v in rows]
    for q, v in dict(whole).items():
        want = sorted((-near(sum(a * b for a, b in zip(v, w))), j) for j, w in whole if j != q)
        assert [(j, s) for _, j, s in sorted(got[q])] == [(j, -s) for s, j in want]
    assert len(got[0]) == len(rows) - 1  # the repeated row takes a rank each time


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64)) * 200
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 20).astype(np.int64)
    for parts in topk.RESOLUTIONS:
        a, b = topk.segment_statistics(x[:50], parts), topk.segment_statistics(x, parts)
        assert (a @ b.T + 1e-3 >= x[:50] @ x.T).all()
    block = topk.Block(np.arange(50), x[:50], 5)
    for at in range(0, 3000, 500):
        block.add(topk.Rows(np.arange(at, at + 500), x[at : at + 500]))
    assert block.compared < 0.6 * 50 * 3000


# --- pipeline ------------------------------------------------------------------------------


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ok = {r.doc_id for r in rules.judge(docs, learned).where("quality_rules.kept").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in ok)
    cut = [(i, c[2], s) for (i, _, s), c in zip(rows, brute_lines([t for _, t, _ in rows])) if not (c[1] and not words(c[2]))]
    first = brute_components([brute_fingerprint(t) for _, t, _ in cut])
    one = [d for k, d in enumerate(cut) if first[k] == k]
    state = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf)
        assert state.columns == docs.columns
        seen.append(Counter((r.doc_id, r.text, r.source) for r in state.collect()))
    assert seen[0] == Counter(rows) and seen[1] == Counter(cut) and seen[2] == Counter(one)
    assert set(seen[3]) <= set(one) and max(seen[3].values()) <= 3
    final = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in final) == Counter({d[0]: n for d, n in seen[3].items()})
    text = {d[0]: d[1] for d in one}
    path = __import__("public_tokenizers").path(bpe.RANKS)
    assert all(bpe.decode_ids(np.array(r.ids, "<u4").tobytes(), path) == text[r.doc_id].encode() for r in final[:40])
