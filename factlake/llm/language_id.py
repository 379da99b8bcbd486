"""Language identification by a linear-chain conditional random field (operator 9).

Each word of a text is labelled with a language. Hashed affix and character n-gram features and a
lexicon learned with them score a word by itself, learned transitions tie neighbours together, and
forward-backward gives each word's posterior, so texts that switch languages are followed word by
word. A document's language is the one with the largest sum of posteriors.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import carried, held_by_worker, restored, short_batches

#: Buckets of hashed features.
BUCKETS = 1 << 15
#: A longer word is cut into pieces of this many letters, which are labelled like words.
LETTERS = 32
#: Words whose scores one worker remembers.
CACHE = 250_000
#: Letters of all languages' training texts together, at most about.
TOGETHER = 20_000_000
#: So many familiar words are added to each text's own before its familiarity is taken, as short texts can't be told.
DOUBT = 10
#: Words that are labelled at a time.
AT_ONCE = 100_000
#: Words between two looks at a chain's state; see :func:`posteriors`.
BLOCK = 32
_EDGES = string.punctuation + string.digits + "«»¿¡…–—“”„‘’·•"


def core(word: str) -> str:
    """A word of :func:`words_of` without the punctuation and digits around it; empty without letters."""
    word = word.strip(_EDGES)
    return word if any(map(str.isalpha, word)) else ""


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased, between white space; a long one in consecutive pieces, so that none of it is lost."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LETTERS:
        return words
    return [w[at : at + LETTERS] for w in words for at in range(0, len(w), LETTERS)]


def _hash(kind: int, *letters: np.ndarray) -> np.ndarray:
    x = np.full(letters[0].shape, kind * 0x9E3779B1, np.uint64)
    for a in letters:
        x = (x ^ a) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(BUCKETS)).astype(np.int32)


def word_features(words: list[str]) -> np.ndarray:
    """Rows of feature numbers: letters at either end (1 to 3) and all 2- and 3-grams; ``BUCKETS`` is none."""
    width = max(map(len, words))
    codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    n = (codes > 0).sum(axis=1)
    padded = np.zeros((len(words), width + 4), np.uint64)
    padded[:, 0] = 1  # marks the beginning; the end is marked by 2
    padded[:, 1 : width + 1] = codes
    padded[np.arange(len(words)), n + 1] = 2
    rows, found = np.arange(len(words)), []
    for k in (1, 2, 3):
        found.append(_hash(k, *(padded[:, i] for i in range(k + 1)))[:, None])
        ends = [padded[rows, np.maximum(n + 1 - i, 0)] for i in range(k + 1)]
        found.append(_hash(10 + k, *ends)[:, None])
    for k in (2, 3):
        grams = _hash(20 + k, *(padded[:, i : i + width + 2] for i in range(k)))
        inside = np.arange(width + 2)[None, :] + k <= n[:, None] + 2
        found.append(np.where(inside, grams, BUCKETS))
    return np.concatenate(found, axis=1)


def trigrams(words: list[str]) -> int:
    """How many of the last columns of :func:`word_features` stand for 3-grams."""
    return max(map(len, words)) + 2


@dataclass
class LanguageModel:
    """Weights of features by language, the lexicon's own weights, and transitions (logarithms)."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    moves: np.ndarray
    #: Which buckets of 3-grams the training words fill, and the familiarity that all but strange texts have.
    seen: np.ndarray | None = None
    least_familiar: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None
    shares: np.ndarray | None = None

    @property
    def name(self) -> str:
        """Equal for equal models, so that a worker keeps what it has learned of words."""
        return hashlib.sha256(self.weights.tobytes() + self.moves.tobytes()).hexdigest()

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None, "letters": None, "shares": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word by language."""
        return self._judged(words)[0]

    def _judged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, and the share of its 3-grams that training words have."""
        out, shares = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        for low, high in ((1, 12), (12, LETTERS + 1)):  # padding follows the longest word
            for at in range(0, len(words), 8192):
                some = [i for i in range(at, min(at + 8192, len(words))) if low <= len(words[i]) < high]
                if some:
                    own = [words[i] for i in some]
                    lexical = np.array([self.lexicon.get(w, -1) for w in own])
                    features = word_features(own)
                    out[some] = self.weights[features].sum(axis=1) + self.weights[BUCKETS + 1 + lexical] * (lexical >= 0)[:, None]
                    if self.seen is not None:
                        shares[some] = self.seen[features[:, -trigrams(own) :]].sum(axis=1) / np.array([len(w) for w in own])
        return out, shares

    def _learn(self, new: list[str]) -> None:
        if self.scores is None:
            self.scores, self.letters = np.zeros((CACHE + AT_ONCE, len(self.labels))), np.zeros(CACHE + AT_ONCE, bool)
            self.shares = np.zeros(CACHE + AT_ONCE)
        cores = [core(w) for w in new]
        at = len(self.known)
        self.scores[at : at + len(new)], self.shares[at : at + len(new)] = self._judged(cores)
        self.letters[at : at + len(new)] = [bool(c) for c in cores]
        self.known.update(zip(new, range(at, at + len(new))))

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language and its share of the posteriors for each of a few texts."""
        return [(lang, share) for lang, share, _ in self.judge(texts)]

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """For each of a few texts its language, that language's share of the posteriors, and its familiarity."""
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat or not self.labels:
            return [("und", 0.0, 0.0)] * len(texts)
        if len(self.known) > CACHE:
            self.known = {}
        new = [w for w in {*flat} if w not in self.known]
        for at in range(0, len(new), AT_ONCE):  # one huge text may bring more than the cache takes
            if len(self.known) > CACHE:
                return self._label_uncached(words, flat)
            self._learn(new[at : at + AT_ONCE])
        at = np.array([self.known[w] for w in flat])
        return self._decide([len(ws) for ws in words], self.scores[at], self.letters[at], self.shares[at])

    def _label_uncached(self, words: list[list[str]], flat: list[str]) -> list[tuple[str, float, float]]:
        cores = [core(w) for w in flat]
        scores, shares = self._judged(cores)
        return self._decide([len(ws) for ws in words], scores, np.array([bool(c) for c in cores]), shares)

    def _decide(self, lengths: list[int], scores: np.ndarray, letters: np.ndarray, shares: np.ndarray) -> list[tuple[str, float, float]]:
        sums = posteriors(scores, letters, np.array(lengths), self.moves)
        best, total = sums.argmax(axis=1), sums.sum(axis=1)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        known = (np.bincount(owner, shares * letters, len(lengths)) + DOUBT) / (np.bincount(owner, letters, len(lengths)) + DOUBT)
        return [(self.labels[b], float(min(1.0, s[b] / t)), k) if t > 0 else ("und", 0.0, 0.0) for b, s, t, k in zip(best, sums, total, known.tolist())]


def posteriors(scores: np.ndarray, counted: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Sums of the words' posteriors for each chain, over the words that are ``counted``.

    ``scores`` holds the chains one after the other. Forward-backward over all chains at once: blocks
    of words become transfer matrices side by side, a scan over the blocks of each chain gives the
    states at their edges, and a second pass fills in the words between. A chain begins with a move
    from an even state.
    """
    n, k = scores.shape
    move = np.exp(moves)
    p = np.ones((n + 1, k))
    p[:n] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -40))
    sums = np.zeros((len(lengths), k))
    chains = np.flatnonzero(lengths)
    lengths = lengths[chains]
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    begin = np.cumsum(lengths) - lengths
    which = np.repeat(np.arange(len(chains)), blocks)
    within = (np.arange(len(which)) - first[which])[:, None] * BLOCK + np.arange(BLOCK)
    real = within < lengths[which][:, None]
    at = np.where(real, begin[which][:, None] + within, n)
    counted = np.append(counted, False)[at]

    # transfer matrices of the blocks
    x = np.broadcast_to(np.eye(k), (len(which), k, k)).copy()
    for t in range(BLOCK):
        step = (x.reshape(-1, k) @ move).reshape(-1, k, k) * p[at[:, t]][:, None, :]
        x = np.where(real[:, t][:, None, None], step, x)
        if t % 4 == 3:
            x /= x.max(axis=(1, 2), keepdims=True)
    # states before and after each block
    order = np.argsort(-blocks, kind="stable")
    heads, tails = first[order], (first + blocks)[order] - 1
    active = [int((blocks > j).sum()) for j in range(int(blocks.max()))]
    ahead, behind = np.empty((len(which), k)), np.empty((len(which), k))
    a, b = np.full((len(order), k), 1 / k), np.ones((len(order), k))
    for j, m in enumerate(active):
        ahead[heads[:m] + j] = a[:m]
        a = np.einsum("ci,cij->cj", a[:m], x[heads[:m] + j])
        a /= a.sum(axis=1, keepdims=True)
        behind[tails[:m] - j] = b[:m]
        b = np.einsum("cij,cj->ci", x[tails[:m] - j], b[:m])
        b /= b.max(axis=1, keepdims=True)
    # words inside
    forward = np.empty((BLOCK, len(which), k))
    a = ahead
    for t in range(BLOCK):
        step = (a @ move) * p[at[:, t]]
        a = np.where(real[:, t][:, None], step / step.sum(axis=1, keepdims=True), a)
        forward[t] = a
    b, own = behind, np.zeros((len(which), k))
    for t in range(BLOCK - 1, -1, -1):
        both = forward[t] * b
        own += both / both.sum(axis=1, keepdims=True) * counted[:, t][:, None]
        step = (b * p[at[:, t]]) @ move.T
        b = np.where(real[:, t][:, None], step / step.max(axis=1, keepdims=True), b)
    sums[chains] = np.add.reduceat(own, first)
    return sums


def train(texts: list[str], langs: list[str], rounds: int = 6, stretch: int = 64, seed: int = 7) -> LanguageModel:
    """Fit the field to labelled texts by stochastic gradients of its log-likelihood.

    Training chains are spliced from stretches of different texts, so that moves between languages
    are learned from text that does switch.
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    k = len(labels)
    pieces, seen = [], [Counter() for _ in labels]
    for text, lang in zip(texts, langs):
        own = [c for w in words_of(text) if (c := core(w))]
        seen[labels.index(lang)].update(own)
        at = 0
        while at < len(own):
            step = int(rng.integers(6, 40))
            pieces.append((labels.index(lang), own[at : at + step]))
            at += step
    total = sum(seen, Counter())
    lexicon = {w: j for j, c in enumerate(seen) for w, n in c.items() if n >= 4 and n > 0.7 * total[w]}
    model = LanguageModel(labels, np.zeros((BUCKETS + 1 + k, k)), lexicon, np.zeros((k, k)), np.zeros(BUCKETS + 1, bool))
    model.moves[:] = np.log(1 / k) if k else 0
    words = sorted(total)
    if not words:
        return model
    # one more feature: the word's entry in the lexicon
    width = max(map(len, words))
    features = word_features([*words, "x" * width])[:-1]
    model.seen[features[:, -trigrams(words) :]] = True
    model.seen[BUCKETS] = False
    lexical = np.array([BUCKETS + 1 + lexicon[w] if w in lexicon else BUCKETS for w in words], np.int32)
    features = np.concatenate([features, lexical[:, None]], axis=1)
    number = {w: i for i, w in enumerate(words)}
    order = rng.permutation(len(pieces))
    flat = np.array([number[w] for i in order for w in pieces[i][1]])
    truth = np.array([pieces[i][0] for i in order for _ in pieces[i][1]])
    chains = max(1, len(flat) // stretch)
    flat, truth = (np.resize(v, (chains, stretch)) for v in (flat, truth))
    w, moves = model.weights, model.moves
    memory, memory_moves, one = np.full_like(w, 1e-6), np.full_like(moves, 1e-6), np.eye(k)
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(chains), max(1, chains // 128)):
            f = features[flat[some]]
            e = w[f].sum(axis=2)
            p, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves)
            a, alphas = np.full((len(some), k), 1 / k), []
            for t in range(stretch):
                a = (a @ move) * p[:, t]
                a /= a.sum(axis=1, keepdims=True)
                alphas.append(a)
            b, by_word, by_move = np.ones((len(some), k)), np.empty_like(p), np.zeros((k, k))
            for t in range(stretch - 1, -1, -1):
                m = alphas[t] * b
                by_word[:, t] = m / m.sum(axis=1, keepdims=True)
                after = p[:, t] * b
                if t:
                    pair = alphas[t - 1][:, :, None] * move * after[:, None, :]
                    by_move += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    np.subtract.at(by_move, (truth[some, t - 1], truth[some, t]), 1)
                b = after @ move.T
                b /= b.max(axis=1, keepdims=True)
            g = (by_word - one[truth[some]]).reshape(-1, k)
            where = f.reshape(len(g), -1)
            grad = np.stack([np.bincount(where.ravel(), np.repeat(g[:, j], where.shape[1]), len(w)) for j in range(k)], axis=1)
            grad = grad / len(some) + 1e-5 * w
            grad[BUCKETS] = 0  # stands for no feature
            memory += grad**2
            w -= 0.3 * grad / np.sqrt(memory)
            by_move /= len(some)
            memory_moves += by_move**2
            moves -= 0.2 * by_move / np.sqrt(memory_moves)
    return model


def training_texts(docs: DataFrame, where: Column, per_language: int, letters: int, languages: int) -> tuple[list[str], list[str]]:
    """About ``per_language`` whole texts of each language, drawn by hash, or fewer: in the order of the hash
    as many as have ``letters`` letters together (with many languages their share of :data:`TOGETHER`), but one
    at least. Of more than ``languages`` values the commonest are learned. These bounds hold at every size of the
    corpus."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    letters = min(letters, TOGETHER // max(1, counts.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    rows = rows.join(F.broadcast(counts), "lang").withColumn("h", drawn).where(F.col("h") < F.lit(per_language * float(1 << 40)) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)) + F.length("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    found = rows.withColumn("first", first).where((F.col("before") <= letters) | (F.col("first") == 1)).select("doc_id", "lang", "text").collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] or 0, r["text"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def calibrated(model: LanguageModel, texts: list[str], langs: list[str], fold: int = 5) -> LanguageModel:
    """Set ``least_familiar``: half the least familiarity that texts of the sample have when the 3-grams of
    all texts but those of their own fold are known."""
    parts = [[[c for w in words_of(t) if (c := core(w))] for t in texts[k::fold]] for k in range(fold)]
    least = 1.0
    for k, own in enumerate(parts):
        others = sorted({w for j, p in enumerate(parts) if j != k for words in p for w in words})
        seen = np.zeros(BUCKETS + 1, bool)
        if others:
            seen[word_features(others)[:, -trigrams(others) :]] = True
            seen[BUCKETS] = False
        for words in own if others else []:
            shares = seen[word_features(words)[:, -trigrams(words) :]].sum(axis=1) / np.array([len(w) for w in words]) if words else np.ones(1)
            least = min(least, float((shares.sum() + DOUBT) / (len(shares) + DOUBT)))
    return replace(model, least_familiar=least / 2)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``familiar`` (both 0 to 1) to the columns ``keep`` (default: ``doc_id``) of ``docs``.

    ``score`` is the language's share of the words' posteriors, which tells the learned languages from one
    another; ``familiar`` is the share of the words' 3-grams that training words have, on the average over
    the words, which tells them from anything else. Texts are read whole, however long. A text that is
    null or has no letter gets ``und`` and 0, as does every text when the model has learned no language.
    Repeated rows give repeated results; an empty table gives no rows. Kept columns may have any name, but those
    of the results give way to them.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = carried(docs, keep or ["doc_id"], F.col("text"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_at = held.value
        own = held_by_worker(("languages", found_at.name), lambda: replace(found_at, known={}, scores=None, letters=None, shares=None))
        for batch in batches:
            found: list[tuple[str, float, float]] = []
            few: list[str] = []
            letters = 0
            for text in batch.column("text"):
                few.append(text.as_py() or "")
                letters += len(few[-1])
                if letters > 6 * AT_ONCE:
                    found += own.judge(few)
                    few, letters = [], 0
            found += own.judge(few) if few else []
            pa.default_memory_pool().release_unused()
            names, scores, familiar = zip(*found) if found else ((), (), ())
            columns = [batch.column("kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "lang_pred", "score", "familiar"])

    return restored(rows.mapInArrow(labelled, f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double, familiar double"))


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, which no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def language_model(docs: DataFrame, per_language: int = 200, letters: int = 500_000, languages: int = 200) -> LanguageModel:
    """Fit on the labelled documents that are not held out (a null ``doc_id`` is held out)."""
    texts, langs = training_texts(docs, F.coalesce(~held_out(F.col("doc_id")), F.lit(False)), per_language, letters, languages)
    return calibrated(train(texts, langs), texts, langs)
