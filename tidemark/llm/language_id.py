"""Language of a text by prediction by partial matching."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows
from tidemark.llm.labelled import fetched

#: Longest context, in bytes.
ORDER = 4
_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of words whose code lengths a worker remembers.
BYTES_KEPT = 8 << 20


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case, as UTF-8."""
    return [w.encode() for w in _LETTERS.findall(text.lower())]


def _grams(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words with a space on either side, one after the other: bytes, place in the word, word."""
    spaced = [b" " + w + b" " for w in words]
    lengths = np.array([len(w) for w in spaced], np.int64)
    data = np.frombuffer(b"".join(spaced), np.uint8).astype(np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return data, np.arange(len(data)) - starts, np.repeat(np.arange(len(lengths)), lengths)


def _keys(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Context of ``order`` bytes and the byte after it, at the given places, as one number."""
    key = np.zeros(len(at), np.int64)
    for i in range(order, -1, -1):
        key = (key << 8) | data[at - i]
    return key


@dataclass
class Tables:
    """Context trees of all languages, frozen.

    For each order, ``seen[order]`` are the sorted keys of contexts with a following byte that any
    language has, and ``bits[order]`` the code lengths of that byte in each; ``known[order]``
    are the sorted contexts and ``escape[order]`` the code lengths of an escape from them, 0 where a
    language does not have the context.
    """

    languages: list[str]
    seen: list[np.ndarray]
    bits: list[np.ndarray]
    known: list[np.ndarray]
    escape: list[np.ndarray]


def learn(rows: Iterable[tuple[bytes, str]]) -> Tables:
    """Context trees up to ``ORDER`` from (text, language) rows.

    A context is the bytes before a byte in its word, the space before the word included, so that
    code lengths of words add up.  A context with n bytes after it, q of them different, gives a byte
    counted c times c / (n + q) and the escape to the next shorter context q / (n + q); below the
    empty context all 256 bytes are alike.
    """
    counts: dict[str, Counter[bytes]] = {}
    for text, language in rows:
        counts.setdefault(language, Counter()).update(words_of(text.decode("utf-8", "replace")))
    languages = sorted(counts)
    tables = Tables(languages, [], [], [], [])
    grams = {}
    for name in languages:
        vocabulary = list(counts[name])
        data, place, word = _grams(vocabulary)
        grams[name] = data, place, np.array([counts[name][w] for w in vocabulary], np.float64)[word]
    for order in range(ORDER + 1):
        each = []
        for name in languages:
            data, place, weight = grams[name]
            at = np.flatnonzero(place >= max(order, 1))
            keys, inverse = np.unique(_keys(data, at, order), return_inverse=True)
            each.append((keys, np.bincount(inverse, weight[at], len(keys))))
        seen = np.unique(np.concatenate([k for k, _ in each])) if each else np.empty(0, np.int64)
        known = np.unique(seen >> 8)
        count = np.zeros((len(seen), len(languages)))
        for i, (keys, c) in enumerate(each):
            count[np.searchsorted(seen, keys), i] = c
        context = np.searchsorted(known, seen >> 8)
        total = np.zeros((len(known), len(languages)))
        different = np.zeros_like(total)
        np.add.at(total, context, count)
        np.add.at(different, context, count > 0)
        has = total > 0
        escape = np.where(has, np.log2(np.where(has, total + different, 1) / np.where(has, different, 1)), 0.0)
        if order:
            below = tables.bits[order - 1][np.searchsorted(tables.seen[order - 1], seen & ((1 << (8 * order)) - 1))]
        else:
            below = np.full((len(seen), len(languages)), 8.0)
        own = np.log2(np.where(count > 0, (total + different)[context], 1) / np.where(count > 0, count, 1))
        tables.seen.append(seen)
        tables.bits.append(np.where(count > 0, own, escape[context] + below))
        tables.known.append(known)
        tables.escape.append(escape)
    return tables


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def code_lengths(words: list[bytes], tables: Tables) -> np.ndarray:
    """Bits that each language needs for each word and the space after it."""
    bits = np.zeros((len(words), len(tables.languages)))
    if not words:
        return bits
    data, place, word = _grams(words)
    escaped = np.empty(0, np.int64)
    for order in range(ORDER, -1, -1):
        # places whose context is as long as this order, and those that escaped to it
        own = place >= order if order == ORDER else (place == order) & (place > 0)
        at = np.concatenate([np.flatnonzero(own), escaped])
        keys = _keys(data, at, order)
        found, there = _find(tables.seen[order], keys)
        np.add.at(bits, word[at[there]], tables.bits[order][found[there]])
        escaped = at[~there]
        context, known = _find(tables.known[order], keys[~there] >> 8)
        np.add.at(bits, word[escaped[known]], tables.escape[order][context[known]])
    np.add.at(bits, word[escaped], 8.0)
    return bits


class Scorer:
    """Code lengths of texts; words that come again are looked up."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.tables.languages)))
        self.size = 0

    def __call__(self, texts: list[bytes | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text."""
        if self.size > BYTES_KEPT:
            self.forget()
        bags = [Counter(words_of((t or b"").decode("utf-8", "replace"))) for t in texts]
        fresh = [w for w in dict.fromkeys(w for bag in bags for w in bag) if w not in self.rows]
        if fresh:
            self.table = np.concatenate([self.table, code_lengths(fresh, self.tables)])
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.size += sum(map(len, fresh))
        for bag in bags:
            if not bag or not self.tables.languages:
                yield "und", 0.0
                continue
            at = np.fromiter(map(self.rows.__getitem__, bag), np.int64, len(bag))
            bits = np.fromiter(bag.values(), np.float64, len(bag)) @ self.table[at]
            best = int(bits.argmin())
            yield self.tables.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def sample(
    docs: DataFrame, usable: Column, most: int, most_languages: int = 200, most_bytes: int = 64 << 20
) -> list[tuple[bytes, str]]:
    """Up to ``most`` (text, lang) rows of each language on the driver, chosen by a hash of doc_id.

    The ``most_languages`` languages with the most rows are learned.  All bounds are the point:
    what is learned from does not grow with the input.  Spark limits the ids of each language
    before it shuffles them; texts are fetched for the chosen ones only.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    largest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    first = Window.partitionBy("lang").orderBy("o", "doc_id")
    chosen = (
        rows.select("doc_id", "lang", F.xxhash64(F.lit("sample"), "doc_id").alias("o"))
        .join(F.broadcast(largest.select("lang")), "lang")
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= most)
        .select("doc_id", F.col("lang").alias("y"), "o")
    )
    return fetched(docs, chosen, most_bytes)


def identify(docs: DataFrame, tables: Tables, at_once: int = 500) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred and score.

    Only doc_id and text are read and only text counts; the whole text does.  lang_pred is the
    language whose context tree needs the fewest bits for the words of the text (of equal ones the
    first by name), and score its probability against the others at even odds.  NULL texts, and texts
    without letters, are ``und`` with score 0, and so are all if no language was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for low in range(0, len(batch["text"]), at_once):
                found = list(scorer(batch["text"][low : low + at_once]))
                yield {
                    "doc_id": batch["doc_id"][low : low + at_once],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                }

    return arrow_rows(docs.select(docs["doc_id"].cast("long"), "text"), each, "doc_id long, lang_pred string, score double")
