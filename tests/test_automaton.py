"""Term automaton against looking for each term alone."""

import random
import time

import pytest

from maskwright.functions import automaton, spans
from maskwright.functions.automaton import Automaton, hits


def alone(text, listed):
    """Term by term, each looked for behind its last place."""
    out = []
    for i, term in enumerate(listed.split("\0")):
        at = text.find(term) if term else -1
        while at >= 0:
            out.append({"i": i, "start": at})
            at = text.find(term, at + len(term))
    return sorted(out, key=lambda h: (h["i"], h["start"]))


def random_lists(rng):
    word = lambda n: "".join(rng.choice("abé𝔘 ") for _ in range(n))
    for _ in range(25):
        terms = [word(rng.randint(0, 7)) for _ in range(rng.randint(1, 80))] + rng.choice([[], ["a" * 50], ["abab", "abab", "bab"]])
        yield "\0".join(terms), [word(rng.choice([0, 3, 40, 700])) for _ in range(9)]


@pytest.mark.parametrize("cells,width", [(1 << 24, 1024), (200, 1024), (1 << 24, 1)])
def test_all_places(monkeypatch, cells, width):
    monkeypatch.setattr(automaton, "MOST_CELLS", cells)
    monkeypatch.setattr(automaton, "WIDTH", width)
    automaton.automata.cache_clear()
    for listed, texts in random_lists(random.Random(5)):
        assert hits(texts, listed) == [alone(t, listed) for t in texts]
    automaton.automata.cache_clear()


def test_a_term_over_a_cut_and_within_others():
    text = "x" * 500 + "needle in a haystack" + "y" * 700 + "needle"
    listed = "\0".join(["needle in a haystack", "needle", "in a", "haystack", "y" * 300])
    assert hits([text, "", text], listed) == [alone(text, listed), [], alone(text, listed)]


def test_same_spans_as_term_by_term(spark, monkeypatch):
    rng = random.Random(8)
    words = ["Widget", "main st", "É", "straße", "𝔘ni", "ab", "aba", "a", "Zeta-9", "\\E.*", ""]
    lists = [words + [f"Term {i}" for i in range(90)], words, [*words, None] * 9, None, [], ["a\0b"] + words * 8]
    rows = [(i, "".join(rng.choice(words + [" ", "x", "TERM 7", "term 71"]) for _ in range(rng.randint(0, 400))), rng.choice(lists)) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, None, lists[0])], "i int, text string, terms array<string>").repartition(3)
    got, want = (spans.with_matches(df, terms="terms", many_terms=many).select("i", "matches").orderBy("i").collect() for many in (True, False))
    assert got == want and sum(len(r.matches) for r in got) > 1000


def test_cost_does_not_grow_with_the_list():
    """Ten thousand texts of a tenant: 5 000 terms cost less than twice 50."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12)))
    texts = [" ".join(word() for _ in range(100)) for _ in range(1500)]
    seconds = {}
    for n in (50, 5000):
        listed = "\0".join(word() + " " + word() for _ in range(n))
        hits(texts[:1], listed)  # built once per list
        runs = []
        for _ in range(3):
            begin = time.process_time()
            hits(texts, listed)
            runs.append(time.process_time() - begin)
        seconds[n] = min(runs)
    assert seconds[5000] < 2 * seconds[50], seconds


def test_one_state_for_each_beginning():
    a = Automaton(["ab", "abc", "b"])
    assert len(a.next) == 5
