"""Many terms in one pass over a text: a trie with failure links, for term lists that are long.

The trie of a list has one state for each beginning of a term. Its rows say where each character leads;
characters that no term holds lead to the start. A state's failure link is the state of its longest
proper end that is also a beginning, and its row is that of the link, overridden by its own children, so
a step is one look-up, whatever the number of terms. Built level by level.

Texts are cut into stretches that all take their next step together; a stretch begins early enough to
hold the longest term that ends in it. Time goes with the text and the hits, not with the list.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# cells of one automaton's table (four bytes each); a longer list becomes several
MOST_CELLS = 1 << 24
# stretches that take a step together, about, and the characters of one at least
WIDTH, LEAST_STRETCH = 1024, 64
# automata that a worker keeps
KEPT = 16


class Automaton:
    """Finds all places of all terms; terms are different and not empty."""

    def __init__(self, terms: list[str]):
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.alphabet = np.array(sorted({ord(c) for t in terms for c in t}), np.uint32)
        kind = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        self.width = width = len(kind) + 1
        children: dict[int, int] = {}
        levels: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # depth -> (state, parent, character)
        self.term_at = [-1]
        for i, t in enumerate(terms):
            state = 0
            for depth, c in enumerate(t):
                key = state * width + kind[c]
                child = children.get(key)
                if child is None:
                    child = children[key] = len(self.term_at)
                    self.term_at.append(-1)
                    levels[depth].append((child, state, kind[c]))
                state = child
            self.term_at[state] = i
        self.term_at = np.array(self.term_at)
        self.next = np.zeros((len(self.term_at), width), np.int32)
        link = np.zeros(len(self.term_at), np.int64)
        # the next shorter term that ends where a state ends
        self.shorter = np.zeros(len(self.term_at), np.int64)
        child, _, c = np.array(levels[0]).T
        self.next[0, c] = child
        for depth in range(len(levels)):
            # the rows of links, which are higher, are done
            state = np.array(levels[depth])[:, 0]
            to = link[state]
            self.next[state] = self.next[to]
            self.shorter[state] = np.where(self.term_at[to] >= 0, to, self.shorter[to])
            if depth + 1 < len(levels):
                child, parent, c = np.array(levels[depth + 1]).T
                link[child] = self.next[link[parent], c]
                self.next[parent, c] = child
        self.ends = (self.term_at >= 0) | (self.shorter > 0)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, term) of every place, by text, term and start; places of one term may overlap."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        kinds = np.where(self.alphabet[place] == codes, place + 1, 0)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        step = max(LEAST_STRETCH, len(codes) // WIDTH, int(self.sizes.max()))
        pieces = -(-lengths // step)
        owner = np.repeat(np.arange(len(texts)), pieces)
        own = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step
        stop = np.minimum(own + step, begins[owner + 1])
        start = np.maximum(own - int(self.sizes.max()) + 1, begins[owner])
        order = np.argsort(start - stop, kind="stable")  # the longest first
        owner, own, start, size = owner[order], own[order], start[order], (stop - start)[order]
        state = np.zeros(len(owner), np.int64)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -i, "left"))
            at = start[:active] + i
            state[:active] = self.next[state[:active], kinds[at]]
            hit = np.flatnonzero(self.ends[state[:active]] & (at >= own[:active]))
            if len(hit):
                hits.append((owner[hit], at[hit], state[hit]))
        none = np.zeros(0, np.int64)
        text, end, state = (np.concatenate([none, *(h[k] for h in hits)]) for k in range(3))
        found = []
        while len(state):
            term = self.term_at[state]
            here = term >= 0
            found.append((text[here], end[here] + 1 - self.sizes[term[here]] - begins[text[here]], term[here]))
            state = self.shorter[state]
            text, end, state = text[state > 0], end[state > 0], state[state > 0]
        text, first, term = (np.concatenate([none, *(f[k] for f in found)]) for k in range(3))
        order = np.lexsort((first, term, text))
        return text[order], first[order], term[order]


def without_overlaps(text: np.ndarray, start: np.ndarray, term: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which places stay if a term is looked for again only behind its last place; input as from ``find``."""
    same = (text[1:] == text[:-1]) & (term[1:] == term[:-1])
    stay = np.ones(len(text), bool)
    close = np.flatnonzero(same & (start[1:] < start[:-1] + size[:-1])) + 1
    if not len(close):
        return stay
    joined = np.concatenate([[False], same]).tolist()
    starts, sizes, last = start.tolist(), size.tolist(), 0
    for i, go in enumerate(joined):
        if go and starts[i] < last:
            stay[i] = False
        else:
            last = starts[i] + sizes[i]
    return stay


def _lists(terms: list[str]) -> Iterator[list[str]]:
    """A list in parts whose tables stay below the limit."""
    part, characters, letters = [], 0, set()
    for t in terms:
        if part and (characters + len(t) + 1) * (len(letters | set(t)) + 1) > MOST_CELLS:
            yield part
            part, characters, letters = [], 0, set()
        part.append(t)
        characters += len(t)
        letters |= set(t)
    if part:
        yield part


@lru_cache(KEPT)
def automata(listed: str) -> list[tuple[Automaton, np.ndarray]]:
    """For a list whose terms are parted by NUL: automata, and for each term the place of it in the list.

    A term that is listed twice has its places joined by ``repeated``.
    """
    places: dict[str, int] = {}
    for i, t in enumerate(listed.split("\0")):
        if t:
            places.setdefault(t, i)
    return [(Automaton(part), np.array([places[t] for t in part])) for part in _lists(list(places))]


@lru_cache(KEPT)
def repeated(listed: str) -> dict[int, list[int]]:
    """First place in the list -> further places of the same term."""
    places: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(listed.split("\0")):
        if t:
            places[t].append(i)
    return {p[0]: p[1:] for p in places.values() if len(p) > 1}


_HITS = pa.list_(pa.struct([("i", pa.int32()), ("start", pa.int32())]))


def hits(texts: list[str], listed: str) -> list[list[dict]]:
    """Per text the places of the terms of one list, by term and start."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    more = repeated(listed)
    for machine, place in automata(listed):
        text, start, term = machine.find(texts)
        stay = without_overlaps(text, start, term, machine.sizes[term])
        for t, s, i in zip(text[stay].tolist(), start[stay].tolist(), place[term[stay]].tolist()):
            out[t] += [(k, s) for k in (i, *more.get(i, ()))]
    return [[{"i": i, "start": s} for i, s in sorted(h)] for h in out]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("start", T.IntegerType())])))
def find_terms(texts: pa.Array, lists: pa.Array) -> pa.Array:
    """Places of the terms of each row's list (parted by NUL) in its text; null where the list is null."""
    rows: dict[str, list[int]] = defaultdict(list)
    for i, listed in enumerate(lists.to_pylist()):
        if listed is not None:
            rows[listed].append(i)
    out: list[list[dict] | None] = [None] * len(texts)
    for listed, at in rows.items():
        for i, h in zip(at, hits([t or "" for t in texts.take(pa.array(at)).to_pylist()], listed)):
            out[i] = h
    return pa.array(out, _HITS)
