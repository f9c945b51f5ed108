"""Language of a text by a linear-chain conditional random field over its words.

A word is described by its character n-grams with word ends, its first and last letters, itself, and the language a
learned lexicon gives it. Feature weights and the transitions between the languages of neighbouring words are
learned together; forward-backward then gives every word of a text its language probabilities, so a text that
switches between languages is labelled word by word. A text's language is the one with most expected words; the
score is its share of them.

Learning uses a bounded sample: about `train_texts` labelled texts of each language and at most `train_words` words of
them, cut into spans that are strung together across languages, which is where switches come from. Prediction takes
every text whole, in blocks of `BLOCK` words whose transfer matrices are chained, so long texts need memory in
proportion to their own words only.

Edge cases: a null text or one without a letter is `und` with score 0; without any labelled text, everything is; with
one language it is that language; rows without an id are never learned from and not held out; repeated rows are
predicted alike; very long texts are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import where_computed

UND = "und"
BLOCK = 64
_NOT_LETTER = re.compile(r"[\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CrfParams:
    train_texts: int = 64
    train_words: int = 40_000
    buckets: int = 1 << 15
    span_words: int = 8
    sequence_words: int = 64
    rounds: int = 30
    rate: float = 0.15
    decay: float = 1e-3
    min_lexicon: int = 3
    seed: int = 42


@dataclass(frozen=True)
class Crf:
    """`weights`: one row for each hashed feature, then one for each lexicon language, then the bias."""

    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_language: np.ndarray
    buckets: int

    def emissions(self, words: list[str]) -> np.ndarray:
        return Features(words, self.buckets, self.lexicon, self.lexicon_language).scores(self.weights)


def tokens(text: str | None) -> list[str]:
    return (text or "").split()


def normalised(word: str) -> str:
    """The letters of a word in lower case; empty if it has none."""
    return word.lower() if word.isalpha() else _NOT_LETTER.sub("", word).lower()


def _bucket(hashes: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(salt * 0x51ED270B)) * _MULT
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


class Features:
    """Feature rows of a list of words, flat: `index` into the weights, `value`, and `owner` word."""

    def __init__(self, words: list[str], buckets: int, lexicon: np.ndarray, lexicon_language: np.ndarray):
        self.n = len(words)
        marked = [f"^{w}$" for w in words]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, marked), np.int64, self.n)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(self.n), size)
        rest = np.repeat(start + size, size) - np.arange(len(chars))  # characters up to the word's end, itself included
        first = np.arange(len(chars)) == start[owner]
        index, value, owners = [], [], []

        def add(rows: np.ndarray, weight: np.ndarray | float, who: np.ndarray) -> None:
            index.append(rows)
            value.append(np.broadcast_to(np.asarray(weight, np.float32), rows.shape))
            owners.append(who)

        rolled = chars.copy()
        for n in (1, 2, 3, 4):
            if n > 1:
                rolled = rolled[: len(chars) - n + 1] * np.uint64(1_000_003) + chars[n - 1:]
            fits = rest[: len(rolled)] >= n
            rows, who = _bucket(rolled[fits], n, buckets), owner[: len(rolled)][fits]
            add(rows, 1.5 / np.maximum(size[who] - n + 1, 1), who)
            if n > 1:  # affixes: n-grams that hold a word end
                begins = fits & first[: len(rolled)]
                ends = fits & (rest[: len(rolled)] == n)
                for salt, which in ((10 + n, begins), (20 + n, ends)):
                    add(_bucket(rolled[which], salt, buckets), 0.5, owner[: len(rolled)][which])
        self.word_hash = word_hashes(chars, start, owner)
        add(_bucket(self.word_hash, 31, buckets), 1.0, np.arange(self.n))
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, self.word_hash), len(lexicon) - 1)
            known = lexicon[at] == self.word_hash
            add(buckets + lexicon_language[at[known]], 1.0, np.arange(self.n)[known])
        self.index, self.value, self.owner = (np.concatenate(x) for x in (index, value, owners))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty((self.n, weights.shape[1]))
        for k in range(weights.shape[1]):
            out[:, k] = np.bincount(self.owner, weights[self.index, k] * self.value, self.n)
        return out + weights[-1]

    def gradient(self, slopes: np.ndarray, rows: int) -> np.ndarray:
        out = np.stack([np.bincount(self.index, slopes[self.owner, k] * self.value, rows) for k in range(slopes.shape[1])], axis=1)
        out[-1] = slopes.sum(axis=0)
        return out


def word_hashes(chars: np.ndarray, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(chars)) - start[owner]).astype(np.uint64)
    mixed = (chars + place * np.uint64(0x100000001B3)) * _MULT
    mixed ^= mixed >> np.uint64(29)
    return np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), start)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; `scores` holds the sequences one after another, `lengths` their words (none 0).

    Blocks of all sequences advance together: first each block's transfer matrix, then the vectors that enter the
    blocks from both sides, then the words inside.
    """
    labels = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    per = -(-lengths // BLOCK)
    n_blocks = int(per.sum())
    first_block = np.cumsum(per) - per
    seq_of_word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(scores)) - (np.cumsum(lengths) - lengths)[seq_of_word]
    block, inside = first_block[seq_of_word] + place // BLOCK, place % BLOCK
    x = np.ones((BLOCK, n_blocks, labels))
    x[inside, block] = np.exp(scores - scores.max(axis=1, keepdims=True))
    used = np.zeros((BLOCK, n_blocks), bool)
    used[inside, block] = True
    opening = np.zeros(n_blocks, bool)
    opening[first_block] = True

    def enter(vector: np.ndarray, at: int) -> np.ndarray:
        """Before a word is weighed: from the labels of the word before; a text's first word starts evenly."""
        moved = vector @ step
        if at == 0:
            shape = (-1,) + (1,) * (vector.ndim - 1)
            even = np.broadcast_to(vector.sum(axis=-1, keepdims=True), moved.shape)
            moved = np.where(opening.reshape(shape), even, moved)
        return moved

    through = np.broadcast_to(np.eye(labels), (n_blocks, labels, labels)).copy()
    for at in range(BLOCK):
        moved = enter(through, at) * x[at][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        through = moved if used[at].all() else np.where(used[at][:, None, None], moved, through)

    left, right = np.full((n_blocks, labels), 1.0 / labels), np.ones((n_blocks, labels))
    longest_first = np.argsort(-per, kind="stable")
    heads, counts = first_block[longest_first], per[longest_first]
    for k in range(1, int(per.max()) if len(per) else 0):
        alive = heads[: np.searchsorted(-counts, -k)]  # sequences with more than k blocks
        vector = np.einsum("bi,bij->bj", left[alive + k - 1], through[alive + k - 1])
        left[alive + k] = vector / vector.sum(axis=1, keepdims=True)
        tails = alive + counts[: len(alive)] - 1 - k
        vector = np.einsum("bij,bj->bi", through[tails + 1], right[tails + 1])
        right[tails] = vector / vector.sum(axis=1, keepdims=True)

    forward = np.empty_like(x)
    vector = left
    for at in range(BLOCK):
        moved = enter(vector, at) * x[at]
        moved /= moved.sum(axis=1, keepdims=True)
        vector = np.where(used[at][:, None], moved, vector)
        forward[at] = vector
    vector = right
    for at in range(BLOCK - 1, -1, -1):
        forward[at] *= vector
        # the first word of a text has nothing before it, so what this gives for it is never read
        moved = (x[at] * vector) @ step.T
        moved /= moved.sum(axis=1, keepdims=True)
        vector = np.where(used[at][:, None], moved, vector)
    forward /= forward.sum(axis=2, keepdims=True)
    return forward[inside, block]


def fit(texts: list[tuple[str, str]], params: CrfParams = CrfParams()) -> Crf:
    """A model from (language, text) pairs, the same for the same pairs in any order."""
    languages = tuple(sorted({language for language, _ in texts}))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(languages)
    empty = Crf(languages, np.zeros((params.buckets + k + 1, k)), np.zeros((k, k)), *none, params.buckets)
    rng = np.random.default_rng(params.seed)
    spans: list[tuple[int, list[str]]] = []
    for language, text in sorted(texts):
        own, at = [w for w in map(normalised, tokens(text)) if w], 0
        while at < len(own):
            n = int(rng.geometric(1 / params.span_words))
            spans.append((languages.index(language), own[at: at + n]))
            at += n
    if not spans or k < 2:
        return empty
    # the same number of words of each language at most, so that a frequent one does not swallow the others
    taken, share = [], params.train_words // k
    room = [share] * k
    for i in rng.permutation(len(spans)):
        label, own = spans[i]
        if room[label] > 0:
            room[label] -= len(own)
            taken.append(spans[i])
    words = [w for _, own in taken for w in own]
    gold = np.repeat([label for label, _ in taken], [len(own) for _, own in taken])
    codes, vocabulary = pd.factorize(np.array(words, dtype=object))
    vocabulary = list(vocabulary)
    table = np.zeros((len(vocabulary), k))
    np.add.at(table, (codes, gold), 1)
    plain = Features(vocabulary, params.buckets, *none)
    sure = (table.sum(axis=1) >= params.min_lexicon) & (table.max(axis=1) >= 0.9 * table.sum(axis=1))
    order = np.argsort(plain.word_hash[sure])
    lexicon, lexicon_language = plain.word_hash[sure][order], table[sure].argmax(axis=1)[order]
    feats = Features(vocabulary, params.buckets, lexicon, lexicon_language)

    size = params.sequence_words
    lengths = np.full(-(-len(codes) // size), size)
    lengths[-1] = len(codes) - size * (len(lengths) - 1)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - lengths] = False
    later = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[later - 1], gold[later]), 1)
    target = np.eye(k)[gold]
    weights, transitions = empty.weights.copy(), empty.transitions.copy()
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for n in range(1, params.rounds + 1):
        unit = feats.scores(weights)
        by_word = unit[codes]
        chance = marginals(by_word, lengths, transitions)
        slopes = np.zeros_like(unit)
        for label in range(k):
            slopes[:, label] = np.bincount(codes, (target - chance)[:, label], len(unit))
        # expected transitions from the pair probabilities of neighbours
        pair = pairs(by_word, chance, later, transitions)
        grads = (feats.gradient(slopes, len(weights)) / 50 - params.decay * weights, (seen - pair) / len(later) - params.decay * transitions)
        for which, (value, grad) in enumerate(zip((weights, transitions), grads, strict=True)):
            first, second = state[2 * which], state[2 * which + 1]
            first *= 0.9
            first += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad * grad
            value += params.rate * (first / (1 - 0.9 ** n)) / (np.sqrt(second / (1 - 0.99 ** n)) + 1e-6)
    return Crf(languages, weights.astype(np.float32), transitions, lexicon, lexicon_language, params.buckets)


def pairs(scores: np.ndarray, chance: np.ndarray, later: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected transition counts, from the exact word marginals: the pair of neighbours (i, j) is scaled so that both
    of its marginals hold (iterative proportional fitting of the local factor, which for a chain is exact)."""
    x = np.exp(transitions - transitions.max())[None] * np.ones((len(later), 1, 1))
    before, after = chance[later - 1], chance[later]
    for _ in range(8):
        x *= (before / np.maximum(x.sum(axis=2), 1e-300))[:, :, None]
        x *= (after / np.maximum(x.sum(axis=1), 1e-300))[:, None, :]
    return x.sum(axis=0)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, key: str, text: str, language: str, params: CrfParams = CrfParams()) -> list[tuple[str, str]]:
    """About `train_texts` labelled texts of each language, by a hash of the id: a rate per language, no sorting."""
    marked = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(language).isNotNull()).where(~held_out(F.col(key)))
    marked = marked.select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(params.seed)).alias("h"))
    counts = {r["language"]: r["count"] for r in marked.groupBy("language").count().collect()}
    if not counts:
        return []
    scale = 1 << 30
    rates = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, max(1, min(scale, scale * params.train_texts // n)))])
    chosen = marked.where(F.pmod("h", F.lit(scale)) < rates[F.col("language")])
    return [(r["language"], r["text"]) for r in chosen.select("language", "text").collect()]


def predict_batch(texts: list[str | None], model: Crf) -> pd.DataFrame:
    """Language, score, words and switches of each text."""
    split = [tokens(t) for t in texts]
    codes, vocabulary = pd.factorize(np.array([w for own in split for w in own], dtype=object))
    plain, known = pd.factorize(np.array([normalised(w) for w in vocabulary], dtype=object))
    spoken = np.array([bool(w) for w in known], bool)
    codes = plain[codes] if len(codes) else codes.astype(np.int64)
    owner = np.repeat(np.arange(len(split)), [len(own) for own in split])
    keep = spoken[codes] if len(codes) else np.zeros(0, bool)
    codes, owner = codes[keep], owner[keep]
    lengths = np.bincount(owner, minlength=len(split))
    out = pd.DataFrame({"lang_pred": [UND] * len(split), "score": 0.0, "n_words": lengths, "n_switches": 0})
    if not len(codes) or not model.languages:
        return out
    scores = np.concatenate([model.emissions(list(known[at: at + 20_000])) for at in range(0, len(known), 20_000)])
    held = np.flatnonzero(lengths)
    chance = marginals(scores[codes], lengths[held], model.transitions)
    share = np.stack([np.bincount(owner, chance[:, k], len(split)) for k in range(chance.shape[1])], axis=1)[held] / lengths[held, None]
    best = chance.argmax(axis=1)
    changes = (best[1:] != best[:-1]) & (owner[1:] == owner[:-1])
    out.loc[held, "lang_pred"] = np.array(model.languages, dtype=object)[share.argmax(axis=1)]
    out.loc[held, "score"] = np.minimum(share.max(axis=1), 1.0)
    out["n_switches"] = np.bincount(owner[1:][changes], minlength=len(split))
    return out


def groups(texts: list[str | None], limit: int = 2_500_000) -> Iterator[list[str | None]]:
    """Runs of texts of at most `limit` characters together, or one longer text."""
    run, size = [], 0
    for t in texts:
        n = len(t or "")
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def label_texts(docs: DataFrame, model: Crf, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with the struct `out`: lang_pred, score, n_words, n_switches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus holds

    @F.pandas_udf("lang_pred string, score double, n_words long, n_switches long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([predict_batch(run, shared.value) for run in groups(list(batch))], ignore_index=True)

    return docs.withColumn(out, predict(F.col(text)))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", params: CrfParams = CrfParams()) -> Crf:
    return fit(sample(docs, key, text, language, params), params)


def identify(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, `held_out`, `lang_pred`, `score`, `n_words`, `n_switches`."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    return label_texts(slim, model, "_text", "_found").select(key, held_out(F.col(key)).alias("held_out"), "_found.*")


def keep(docs: DataFrame, model: Crf, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Documents whose language is known with at least `min_score`, with their own columns only."""
    own = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    found = label_texts(own, model, "_text", "_found")
    return where_computed(found, (F.col("_found.lang_pred") != UND) & (F.col("_found.score") >= min_score)).select("_row.*")
