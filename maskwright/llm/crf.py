"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes and n-grams of bytes (those that touch a boundary mark are affixes)
and its entry in a lexicon of words that are frequent in the training sample. Transitions between
words are learned on spliced texts, whose pieces come from documents of different languages, so that
the field labels the words of code-switched text. Marginals come from forward-backward.

Defined results: a text that is null or has no letter is ``und`` with score 0. Words without a letter
have no features of their own; they pass the chain on and do not count in the score. Equal masses go
to the language of the smaller code points. Repeated rows are labelled one by one; an empty table, or
one without any language, gives a model without languages, which calls every text ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import column, slices_by_size

# buckets of hashed features, lengths of n-grams, and words of a block of the chain
BUCKETS, NGRAMS, BLOCK = 1 << 17, (2, 3, 4, 5), 64
MARK = 0  # byte that stands at both ends of a word
UNKNOWN = "und"
_U = np.uint64


@dataclass
class Words:
    """Distinct words, ready for features: bytes with marks, where each word begins, and the code of each token."""

    raw: np.ndarray
    begin: np.ndarray
    codes: np.ndarray  # by token: number of its word
    tokens: np.ndarray  # by text: number of tokens
    empty: np.ndarray  # by word: it has no letter


def split_words(texts: pa.Array) -> Words:
    """Tokens of the texts, lower-cased and without what is not a letter."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    whole = pc.not_equal(flat, "")  # white space at the ends of a text leaves empty words
    owner = pc.list_parent_indices(lists)
    tokens = np.bincount(owner.filter(whole).to_numpy(), minlength=len(texts)).astype(np.int64)
    coded = flat.filter(whole).dictionary_encode()
    words = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", "").cast(pa.large_binary())
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    body = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    begin = np.cumsum(size + 2) - (size + 2)
    raw = np.full(int((size + 2).sum()), MARK, np.uint8)
    raw[np.arange(len(body)) + 1 + 2 * np.repeat(np.arange(len(size)), size)] = body
    return Words(raw, begin, coded.indices.to_numpy(zero_copy_only=False), tokens, size == 0)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams. The longest n-grams are used at the ends of a word only."""
    n = len(words.raw)
    of = np.repeat(np.arange(len(words.begin)), np.diff(np.append(words.begin, n)))
    first = np.zeros(n, bool)
    first[words.begin] = True
    value = words.raw.astype(_U)
    key, out = value, []
    for size in range(2, max(NGRAMS) + 1):
        key = key[:-1] << _U(8) | value[size - 1 :] if n >= size else key[:0]
        if size not in NGRAMS:
            continue
        at = np.flatnonzero(of[: len(key)] == of[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        if size == max(NGRAMS):
            last = np.append(first[1:], True)  # the closing mark of a word
            at = at[first[at] | last[at + size - 1]]
        out.append((of[at], (_hash(key[at] | _U(size) << _U(56)) % _U(BUCKETS)).astype(np.int64)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def word_hashes(words: Words) -> np.ndarray:
    """64 bits of each word, for the lexicon."""
    if not len(words.begin):
        return np.zeros(0, _U)
    at = np.arange(len(words.raw)) - np.repeat(words.begin, np.diff(np.append(words.begin, len(words.raw))))
    return np.add.reduceat(_hash(words.raw.astype(_U) << _U(40) | at.astype(_U)), words.begin)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets, then lexicon entries; by language
    lexicon: np.ndarray  # sorted hashes of words
    transition: np.ndarray
    start: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of every token; 0 for words without a letter."""
        of, bucket = self.active(words)
        scores = np.zeros((len(words.begin), len(self.languages)))
        for k in range(len(self.languages)):
            scores[:, k] = np.bincount(of, self.weights[bucket, k], minlength=len(scores))
        scores[words.empty] = 0
        return scores[words.codes]

    def active(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        of, bucket = features(words)
        hashes = word_hashes(words)
        at = np.searchsorted(self.lexicon, hashes)
        known = np.flatnonzero(np.append(self.lexicon, _U(0))[at] == hashes) if len(self.lexicon) else np.zeros(0, np.int64)
        return np.concatenate([of, known]), np.concatenate([bucket, BUCKETS + at[known]])


def marginals(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each token's label, and expected transitions into each token, summed (label to label).

    Chains stand one behind the other; ``begins`` marks their first tokens. The row of tokens is cut into
    blocks: their transfer matrices give the vectors that enter and leave each block, and then all
    blocks are walked through side by side. Scaling at each step cancels out.
    """
    n, k = emission.shape
    blocks = max(1, -(-n // BLOCK))
    padded = blocks * BLOCK
    weight = np.ones((padded, k))
    weight[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    fresh = np.ones(padded, bool)
    fresh[:n] = begins
    weight, fresh = weight.reshape(blocks, BLOCK, k), fresh.reshape(blocks, BLOCK)
    step, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    # transfer of each block: from the vector before its first token to that at its last
    transfer = np.repeat(np.eye(k)[None], blocks, axis=0)
    for t in range(BLOCK):
        moved = transfer @ step
        reset = fresh[:, t]
        moved[reset] = transfer[reset].sum(axis=2, keepdims=True) * first
        moved *= weight[:, t, None, :]
        transfer = moved / moved.sum(axis=(1, 2), keepdims=True)
    entry = np.empty((blocks, k))
    leave = np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        entry[b] = v
        v = v @ transfer[b]
        v /= v.sum()
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = transfer[b] @ v
        v /= v.sum()
    alpha = np.empty((blocks, BLOCK, k))
    v = entry
    for t in range(BLOCK):
        v = np.where(fresh[:, t, None], first, v @ step) * weight[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    posterior = np.empty((blocks, BLOCK, k))
    pairs = np.zeros((k, k))
    beta = leave
    for t in range(BLOCK - 1, -1, -1):
        p = alpha[:, t] * beta
        posterior[:, t] = p / p.sum(axis=1, keepdims=True)
        inner = weight[:, t] * beta
        before = alpha[:, t - 1] if t else entry
        on = ~fresh[:, t]
        if on.any():
            joint = before[on][:, :, None] * step * inner[on][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = np.where(fresh[:, t, None], (inner * first).sum(axis=1, keepdims=True), inner @ step.T)
        beta = beta / beta.sum(axis=1, keepdims=True)
    return posterior.reshape(padded, k)[:n], pairs


def _first_tokens(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(int(tokens.sum()), bool)
    out[(np.cumsum(tokens) - tokens)[tokens > 0]] = True
    return out


def train(texts: list[str], labels: list[str], rounds: int = 25, rate: float = 0.15, decay: float = 1e-4, seed: int = 7, least_count: int = 5) -> Model:
    """Fit the field to spliced texts by gradient steps on the mean conditional log-likelihood (Adam)."""
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, np.zeros((BUCKETS, k)), np.zeros(0, _U), np.zeros((k, k)), np.zeros(k))
    words = split_words(pa.array(texts, pa.string()))
    total = len(words.codes)
    if k == 0 or total == 0:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0, _U), np.zeros((0, 0)), np.zeros(0))
    gold = np.repeat([languages.index(x) for x in labels], words.tokens)
    # pieces of 8 to 40 words of all texts, in random order; some twelve of them make a text
    rng = np.random.default_rng(seed)
    cut, ends = np.cumsum(rng.integers(8, 41, total // 8 + 1)), np.cumsum(words.tokens)
    edges = np.unique(np.concatenate([[0], cut[cut < total], ends[ends < total], [total]]))
    order = rng.permutation(len(edges) - 1)
    take = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in order])
    begins = np.zeros(total, bool)
    begins[np.concatenate([[0], np.cumsum(np.diff(edges)[order])[11:-1:12]])] = True
    codes, gold = words.codes[take], gold[take]
    counts = np.bincount(codes, minlength=len(words.begin))
    frequent = word_hashes(words)[(counts >= least_count) & ~words.empty]
    model.lexicon = np.unique(frequent)
    model.weights = np.zeros((BUCKETS + len(model.lexicon), k))
    words.codes = codes
    of, bucket = model.active(words)
    live = ~words.empty[of]
    of, bucket = of[live], bucket[live]
    right = np.zeros((total, k))
    right[np.arange(total), gold] = 1
    inner = np.flatnonzero(~begins)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    started = right[begins].sum(axis=0)
    parts = [model.weights, model.transition, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for t in range(1, rounds + 1):
        posterior, pairs = marginals(model.emissions(words), begins, model.transition, model.start)
        gap = right - posterior
        by_word = np.stack([np.bincount(codes, gap[:, j], minlength=len(words.begin)) for j in range(k)], axis=1)
        push = np.stack([np.bincount(bucket, by_word[of, j], minlength=len(model.weights)) for j in range(k)], axis=1)
        gradients = [push / total, (seen - pairs) / total, (started - posterior[begins].sum(axis=0)) / total]
        for p, g, (m, v) in zip(parts, gradients, moments):
            g = g - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by their id; nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, characters: int = 2000
) -> Model:
    """Train on about ``per_language`` documents of every language, chosen by hash.

    Of each, one piece of ``characters`` from a hashed place is used. Held-out rows, and rows without an
    id, a text or a language, are left out. Counts by language are what else reaches the driver.
    """
    d, t = column(docs, doc_id), column(docs, text)
    usable = docs.where(d.isNotNull() & t.isNotNull() & column(docs, lang).isNotNull() & ~held_out(d))
    known = usable.select(d.alias("d"), column(docs, lang).alias("lang"), t.alias("t"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return train([], [])
    scale = 1 << 30
    share = F.create_map(*(F.lit(x) for lang_, n in counts.items() for x in (lang_, min(scale, scale * per_language * 1.2 / n))))
    h = F.xxhash64(F.lit("crf"), "d")
    chosen = known.where(F.pmod(h, F.lit(scale)) < F.element_at(share, F.col("lang")))
    start = F.pmod(F.shiftright(h, 30), F.greatest(F.length("t") - characters, F.lit(1))).cast("int") + 1
    piece = chosen.select(h.alias("h"), "lang", F.substr("t", start, F.lit(characters)).alias("t"))
    rows = piece.orderBy("h", "lang", "t").limit(2 * per_language * len(counts)).collect()
    return train([r["t"] for r in rows], [r["lang"] for r in rows])


def label_batch(texts: pa.Array, model: Model) -> tuple[Words, np.ndarray]:
    """Words of the texts, and the marginals of each token."""
    words = split_words(texts)
    if not len(words.codes) or not model.languages:
        return words, np.zeros((len(words.codes), len(model.languages)))
    return words, marginals(model.emissions(words), _first_tokens(words.tokens), model.transition, model.start)[0]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", bytes_at_once: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runs): the language of most words' mass, its mean marginal, and
    runs of words of one label as (lang, n_words)."""
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, out, texts in slices_by_size(batch.columns, batch.column(2), bytes_at_once):
                words, marginal = label_batch(texts, model)
                owner = np.repeat(np.arange(len(texts)), words.tokens)
                counted = ~words.empty[words.codes] if len(words.codes) else np.zeros(0, bool)
                n = np.bincount(owner[counted], minlength=len(texts))
                mass = np.stack([np.bincount(owner[counted], m[counted], minlength=len(texts)) for m in marginal.T], axis=1) if len(model.languages) else np.zeros((len(texts), 1))
                mass = np.round(mass / np.maximum(n, 1)[:, None], 6)
                best = np.where((n > 0) & bool(model.languages), mass.argmax(axis=1), len(model.languages))
                score = np.where((n > 0) & bool(model.languages), mass.max(axis=1), 0.0)
                label = marginal.argmax(axis=1) if len(model.languages) else np.zeros(len(owner), int)
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(owner)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))]).astype(np.int32)
                lang = pa.array(names[label[first]] if model.languages else np.full(len(first), UNKNOWN), pa.string())
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([lang, pa.array(sizes.astype(np.int32))], ["lang", "n_words"]))
                yield pa.RecordBatch.from_arrays(
                    [ids, out, pa.array(names[best], pa.string()), pa.array(score), runs], ["doc_id", "held_out", "lang_pred", "score", "runs"]
                )

    d = column(docs, doc_id)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, lang_pred string, score double, runs array<struct<lang:string,n_words:int>>"
    return docs.select(d.alias("doc_id"), held_out(d).alias("held_out"), column(docs, text).alias("t")).mapInArrow(run, schema)
