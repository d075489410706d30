"""Document quality by supervised subword embeddings."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_rows

#: Rows of the embedding table that hashed n-grams share.
BITS = 17
BUCKETS = 1 << BITS
#: Lengths of the character n-grams of a word, its edges marked.
CHARACTERS = (3, 4, 5)
WORDS_KEPT = 300_000


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, and the number of the word each is of.

    Characters are bytes of UTF-8; a word's edges are marked by < and >.
    """
    marked = [b"<" + w + b">" for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked) + bytes(8), np.uint8)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(word))
    buckets = [np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS]
    owners = [np.arange(len(words))]
    for n in CHARACTERS:
        key = np.full(len(word), n, np.uint64)
        for i in range(n):
            key = (key << np.uint64(8)) | data[i : i + len(word)]
        whole = left >= n
        buckets.append(((key[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[whole])
    return np.concatenate(buckets), np.concatenate(owners)


#: Bucket of the word n-gram "two words that this text had before".
AGAIN = zlib.crc32(b"2again") % BUCKETS
FRESH = zlib.crc32(b"2fresh") % BUCKETS


def pairs_again(words: list[bytes]) -> int:
    """How many pairs of neighbouring words are repetitions."""
    return max(len(words) - 1, 0) - len(set(zip(words, words[1:], strict=False)))


@dataclass(frozen=True)
class Model:
    """What scoring needs: for each bucket, its vector's part in the difference of the two outputs."""

    parts: np.ndarray
    bias: float


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, each once, and their shares of all its n-grams.

    Word pairs are hashed by whether the text had them before, each counting as often as a word's
    own n-grams, so that repetition has a vector too.
    """
    words = text.split()
    counted = Counter(words)
    found, owner = features_of(list(counted))
    times = np.fromiter(counted.values(), np.float64, len(counted))[owner]
    again = pairs_again(words)
    found = np.append(found, [AGAIN, FRESH])
    times = np.append(times, [10 * again, 10 * max(len(words) - 1 - again, 0)])
    ids, place = np.unique(found, return_inverse=True)
    shares = np.bincount(place, times, len(ids))
    return ids, (shares / max(shares.sum(), 1)).astype(np.float32)


def train(
    rows: list[tuple[bytes, int]], dim: int = 8, epochs: int = 12, rate: float = 1.0, seed: int = 7
) -> Model:
    """Fit vectors and output weights by stochastic gradient descent on (text, 0 or 1) rows.

    A document is the mean of the vectors of its n-grams; a softmax over two outputs gives the
    probability of the label.  A step moves a document's mean by the same amount however long the
    document is, and steps shrink to nothing over the epochs.  Without rows every score is one half.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights = np.zeros((2, dim), np.float32)
    weights[1], weights[0] = 1 / dim, -1 / dim
    bias = np.zeros(2, np.float32)
    bags = [(*bag(text), int(label)) for text, label in rows if text.split()]
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in random.permutation(len(bags)):
            ids, shares, label = bags[k]
            mean = shares @ vectors[ids]
            out = weights @ mean + bias
            out = np.exp(out - out.max())
            error = out / out.sum()
            error[label] -= 1
            now = rate * (1 - step / steps)
            back = error @ weights
            weights -= now * 0.1 * np.outer(error, mean)
            bias -= now * 0.05 * error
            vectors[ids] -= (now / (shares @ shares)) * shares[:, None] * back[None, :]
            step += 1
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores of texts; the parts of words that come again are looked up."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, tuple[float, int]] = {}

    def __call__(self, texts: list[bytes | None]) -> list[float]:
        """Probability of label 1 for each text; without words it is that of the bias alone."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        split = [(t or b"").split() for t in texts]
        bags = [Counter(words) for words in split]
        fresh = [w for w in dict.fromkeys(w for bag in bags for w in bag) if w not in self.known]
        if fresh:
            found, owner = features_of(fresh)
            sums = np.bincount(owner, self.model.parts[found], len(fresh)).tolist()
            numbers = np.bincount(owner, minlength=len(fresh)).tolist()
            self.known.update(zip(fresh, zip(sums, numbers, strict=True), strict=True))
        return [self._score(words, bag) for words, bag in zip(split, bags, strict=True)]

    def _score(self, words: list[bytes], bag: Counter[bytes]) -> float:
        total, number = 0.0, 0
        for word, n in bag.items():
            part, k = self.known[word]
            total += n * part
            number += n * k
        again = pairs_again(words)
        fresh = max(len(words) - 1 - again, 0)
        total += 10 * (again * float(self.model.parts[AGAIN]) + fresh * float(self.model.parts[FRESH]))
        number += 10 * (again + fresh)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total / max(number, 1) + self.model.bias))))


def score(docs: DataFrame, model: Model, at_once: int = 500) -> DataFrame:
    """Per row of ``docs``: doc_id and score, the probability (0 to 1) of label 1.

    Only doc_id and text are read and only text counts; the whole text does.  NULL and empty texts
    get the score of a text without words.  Equal texts get equal scores, whatever else their rows
    hold; tables without rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for low in range(0, len(batch["text"]), at_once):
                part = slice(low, low + at_once)
                yield {"doc_id": batch["doc_id"][part], "score": scorer(batch["text"][part])}

    return arrow_rows(docs.select(docs["doc_id"].cast("long"), "text"), each, "doc_id long, score double")
