"""Byte-level BPE by merge replay over a vocabulary of words, with an inverted index of token pairs.

The pattern cuts texts into words. All words of a batch that are not known yet are merged together:
an index from the rank of a token pair to the positions where it stands is worked off in the order of
ranks, and every merge touches the two neighbours of its position only. Words do not influence one
another, so short ones advance side by side as arrays, each by its first entry of the index; long ones
go through a heap of ranks. The words' ids are then put together to the ids of the texts.

Defined results: a null text is encoded as an empty one. There are no special tokens. Extra columns do
not matter, and every row, repeated or not, gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import by_document, column

RANKS = "byte_bpe_multi_50k.tiktoken"
# Classes of characters; endings that the pattern cuts off behind an apostrophe.
OTHER, LETTER, NUMBER, SPACE = range(4)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# Fixed value: the code points with Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# words and pairs that one Python worker remembers; beyond it, it starts anew
REMEMBERED = 600_000
# words of more bytes go through the heap
LONG_WORD = 40
# text that is encoded together
BYTES_AT_ONCE = 8 << 20
NONE = np.int64(1 << 62)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint32)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[WHITE] = SPACE
    return out


def word_starts(codes: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin, in texts that stand one after another; ``begins`` marks their first characters.

    Runs of one class are words. The last of several white-space characters, if a blank, belongs to
    the run behind it, as a single blank does; another one stands alone. An apostrophe that no blank
    precedes takes one of the endings from the letters behind it.
    """
    n = len(codes)
    kind = classes[codes]
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    space = kind[run] == SPACE
    follows = np.zeros(len(run), bool)  # a run with a neighbour in the same text behind it
    follows[:-1] = ~begins[run[1:]]
    last = np.append(run[1:], n) - 1
    # white space before another run: its last character is cut off; a blank goes to that run
    cut = space & follows
    start[last[cut]] = True
    blank = cut & (codes[last] == 32)
    taken = last[blank] + 1
    start[taken] = False
    # apostrophes
    quote = np.flatnonzero((codes == 39) & start)
    for length in (2, 1):
        quote = quote[quote + length < n]
        ends = [e for e in ENDINGS if len(e) == length]
        hit = np.zeros(len(quote), bool)
        for e in ends:
            same = np.ones(len(quote), bool)
            for i, c in enumerate(e):
                same &= (codes[quote + 1 + i] == ord(c)) & ~begins[quote + 1 + i]
            hit |= same
        found = quote[hit]
        start[found + 1] = False
        behind = found + 1 + length
        behind = behind[behind < n]
        start[behind] = True
        quote = quote[~hit]
    return start


class Merger:
    """Ids of words by replaying merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.words: dict[bytes, bytes] = {}
        self.pairs: dict[tuple[int, int], int | None] = {}
        pairs = []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, r))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [NONE], np.int64)
        self.values = np.array([p[1] for p in pairs] + [0], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, a: int, b: int) -> int | None:
        pair = (a, b)
        try:
            return self.pairs[pair]
        except KeyError:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            r = self.pairs[pair] = self.ranks.get(self.token[a] + self.token[b])
            return r

    def learn(self, words: set[bytes]) -> None:
        """Add words that are not known yet."""
        new = []
        for w in words:
            whole = self.ranks.get(w)
            if whole is None and w:
                new.append(w)
            else:
                self.words[w] = b"" if whole is None else whole.to_bytes(4, "little")
        short = [w for w in new if len(w) <= LONG_WORD]
        long = [w for w in new if len(w) > LONG_WORD]
        self.words.update(zip(short, self.replay_side_by_side(short)))
        self.words.update(zip(long, self.replay(long)))

    def places(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Entries (rank, position) of the index for pairs of symbols; NONE where no merge exists."""
        key = a << 32 | b
        i = np.searchsorted(self.keys, key)
        return np.where((self.keys[i] == key) & (b >= 0), self.values[i] << 32 | at, NONE)

    def replay_side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Apply every merge in rank order to short words, one merge of each word at a time."""
        if not words:
            return []
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        number = np.arange(len(words))
        while len(number):
            # one row of slots for the words that are not done yet
            n, first = len(symbol), np.cumsum(size) - size
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            before[first] = -1
            after[first + size - 1] = -1
            behind = np.where(after >= 0, symbol[np.minimum(after, n - 1)], -1)
            index = self.places(symbol, behind, np.arange(n))
            while True:
                lowest = np.minimum.reduceat(index, first)
                i = lowest[lowest < NONE] & 0xFFFFFFFF
                if 2 * len(i) <= len(first):
                    break
                r, j = index[i] >> 32, after[i]
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i], index[j] = r, -1, k, NONE
                before[k[k >= 0]] = i[k >= 0]
                index[i] = self.places(r, np.where(k >= 0, symbol[k], -1), i)
                index[h[h >= 0]] = self.places(symbol[h[h >= 0]], r[h >= 0], h[h >= 0])
            live = symbol >= 0
            tokens, ends = symbol[live].astype("<u4").tobytes(), 4 * np.cumsum(np.add.reduceat(live, first))
            done = lowest >= NONE
            begin = np.concatenate([[0], ends[:-1]])
            for w, a, b in zip(number[done].tolist(), begin[done].tolist(), ends[done].tolist()):
                out[w] = tokens[a:b]
            keep = np.repeat(~done, size) & live
            size = (ends - begin)[~done] // 4
            symbol, number = symbol[keep], number[~done]
        return out

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Apply every merge in rank order to all words.

        Symbols of all words stand in one row; word ends break the links between neighbours.
        """
        rank, byte_id = self.rank, [self.ranks[bytes([b])] for b in range(256)]
        symbol = [byte_id[b] for b in b"".join(words)]
        n = len(symbol)
        after, before, word_of = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        firsts, at = [], 0
        for k, w in enumerate(words):
            firsts.append(at)
            before[at] = -1
            word_of[at : at + len(w)] = [k] * len(w)
            at += len(w)
            after[at - 1] = -1
        index: dict[int, list[int]] = {}  # rank of a pair -> positions of its left symbol
        for i in range(n):
            j = after[i]
            if j >= 0 and (r := rank(symbol[i], symbol[j])) is not None:
                index.setdefault(r, []).append(i)
        order = list(index)
        heapq.heapify(order)
        while order:
            r = heapq.heappop(order)
            places = index.pop(r)
            places.sort()  # in a word, the leftmost of equal ranks goes first
            waits = -1  # a word in which a lower rank has come up: its further places wait for that
            for i in places:
                j = after[i]
                if j < 0 or symbol[i] < 0 or rank(symbol[i], symbol[j]) != r:
                    continue
                if word_of[i] == waits:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(order, r)
                    index[r].append(i)
                    continue
                k = after[j]
                symbol[i], symbol[j], after[i] = r, -1, k
                if k >= 0:
                    before[k] = i
                    if (x := rank(r, symbol[k])) is not None:
                        if x not in index:
                            index[x] = []
                            heapq.heappush(order, x)
                        index[x].append(i)
                        if x <= r:
                            waits = word_of[i]
                h = before[i]
                if h >= 0 and (x := rank(symbol[h], r)) is not None:
                    if x not in index:
                        index[x] = []
                        heapq.heappush(order, x)
                    index[x].append(h)
                    if x <= r:
                        waits = word_of[i]
        out = []
        for i in firsts:
            ids = array("I")
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids.tobytes())
        return out


_MERGERS: dict[str, Merger] = {}
_CLASSES: list[np.ndarray] = []


def _worker(path: str) -> tuple[Merger, np.ndarray]:
    """Kept for all tasks of a Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(read_ranks(path))
    if not _CLASSES:
        _CLASSES.append(character_classes())
    return _MERGERS[path], _CLASSES[0]


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit integers."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > BYTES_AT_ONCE:
            out += _encode_some(part, path)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + _encode_some(part, path)


def _encode_some(texts: list[bytes], path: str) -> list[bytes]:
    merger, classes = _worker(path)
    blob = b"".join(texts)
    if not blob:
        return [b""] * len(texts)
    raw = np.frombuffer(blob, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each character
    codes = np.frombuffer(blob.decode("utf-8").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.zeros(len(codes), bool)
    begins[np.searchsorted(lead, offsets[:-1][sizes > 0])] = True
    starts = lead[word_starts(codes, classes, begins)]
    edges = np.append(starts, len(blob)).tolist()
    words = [blob[a:b] for a, b in zip(edges, edges[1:])]
    if len(merger.words) > REMEMBERED:
        merger.words.clear()
    new = set(words).difference(merger.words)
    if new:
        merger.learn(new)
    known = merger.words
    at = np.searchsorted(starts, offsets).tolist()
    return [b"".join([known[w] for w in words[a:b]]) for a, b in zip(at, at[1:])]


def decode_ids(ids: bytes, path: str) -> bytes:
    token = _worker(path)[0].token
    return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


SCHEMA = "doc_id {id}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ``ids`` only where asked for."""
    path = path or public_tokenizers.path(RANKS)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = SCHEMA.format(id=id_type) if with_ids else SCHEMA.format(id=id_type).replace(" ids array<int>,", "")

    def work(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        names, texts = columns
        ids = encode_texts([t or b"" for t in texts.to_pylist()], path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        counts = [len(x) // 4 for x in ids]
        out = [names, pa.array(counts, pa.int64())]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
        out += [pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(decode_ids(x, path)) for x in ids], pa.string())]
        yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return by_document(docs, [column(docs, doc_id).alias("doc_id"), column(docs, text).cast("binary").alias("t")], schema, work)
