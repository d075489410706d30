"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_rows

#: Letters and signs that stand in for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
#: Signs inside a word that are passed over.
INSIDE = "*.-_'’­​‌‍⁠﻿"
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INSIDE}
#: Shortest and longest beginning of a word that the lexicon may hold.
SHORTEST, LONGEST = 4, 8


def fold(text: str) -> str:
    """Words of a text in lower case, lookalikes and digits as letters, one space around each.

    Full-width and other compatibility forms become plain.  Signs at the edges of a word are no
    part of it; those inside it are passed over, and digits count as letters only in words that have
    letters.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = []
    for word in text.lower().split():
        if not word.isalpha():
            word = word.strip("!\"#$%&()*+,./:;<=>?[\\]^`{|}~-_'«»“”„…")
            if not word.isalpha() and any(map(str.isalpha, word)):
                word = word.translate(_FOLD)
            elif word.isalpha() and not word.isascii():
                word = word.translate(_FOLD)
        elif not word.isascii():
            word = word.translate(_FOLD)
        if word:
            words.append(word)
    return " " + " ".join(words) + " " if words else ""


@dataclass
class Lexicon:
    """Terms with weights: " word " is a whole word, " be" the beginning of one.

    ``exceptions`` are pairs of folded words in which a term does not count.  ``line`` has the
    three coefficients of the score.
    """

    terms: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    line: tuple[float, float, float] = (-4.0, 1.0, 0.5)


def matcher(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """The automaton of all terms; none for an empty lexicon."""
    if not lexicon.terms:
        return None
    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.terms.items():
        automaton.add_word(term, (len(term), weight))
    automaton.make_automaton()
    return automaton


def hits(folded: str, automaton: ahocorasick.Automaton | None, exceptions: set[tuple[str, str]]) -> list[tuple[int, float]]:
    """Place and weight of each word that a term matches, the heaviest term counting."""
    if automaton is None or not folded:
        return []
    best: dict[int, float] = {}
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight > best.get(start, 0.0):
            best[start] = weight
    if exceptions:
        for start in list(best):
            stop = folded.index(" ", start + 1)
            word = folded[start + 1 : stop]
            before = folded[:start].rpartition(" ")[2]
            after = folded[stop + 1 :].partition(" ")[0]
            if (before, word) in exceptions or (word, after) in exceptions:
                del best[start]
    return sorted(best.items())


def measures(folded: str, found: list[tuple[int, float]]) -> tuple[float, float]:
    """Weight of all hits, and per 100 words, both on a logarithmic scale."""
    total = sum(w for _, w in found)
    words = max(folded.count(" ") - 1, 1)
    return math.log1p(total), math.log1p(100 * total / words)


def _score(x: tuple[float, float], line: tuple[float, float, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, line[0] + line[1] * x[0] + line[2] * x[1]))))


def chance(n: int, other: int, share: float) -> float:
    """Probability that ``n`` or more of ``n + other`` documents have label 1 if each has it with probability ``share``."""
    if not 0 < share < 1:
        return float(n == 0 or share >= 1)
    total = n + other
    ways = math.lgamma(total + 1)
    return math.fsum(
        math.exp(
            ways - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share)
        )
        for k in range(n, total + 1)
    )


def learn(
    rows: Iterable[tuple[bytes, int]], least_documents: int = 5, least_weight: float = 2.0, most_chance: float = 1e-4
) -> Lexicon:
    """A lexicon from (text, 0 or 1) rows.

    Candidates are whole folded words and beginnings of words.  The weight of a term is the
    logarithm of how much more often documents of label 1 hold it; terms with less weight are left
    out, those in fewer than ``least_documents`` documents of label 1, those that chance would deal
    to documents of label 1 as often with more than ``most_chance``, and beginnings that stand for
    little else than one longer term.  Nothing depends on a term's share of label 1, so the words
    of a small language or source are learned beside those of a large one.  Pairs of words around a
    term that only documents of label 0 hold, three or more of them, become exceptions.  The score's
    line is then fitted to the rows.
    """
    rows = [(fold(text.decode("utf-8", "replace")), int(label)) for text, label in rows]
    number = Counter(label for _, label in rows)
    holding: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for folded, label in rows:
        words = set(folded.split())
        terms = {f" {w} " for w in words}
        terms |= {f" {w[:n]}" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}
        holding[label].update(terms)
    weighted, share = {}, number[1] / max(len(rows), 1)
    for term, n in holding[1].items():
        if n >= least_documents:
            weight = math.log((n + 0.5) / (number[1] + 1)) - math.log((holding[0][term] + 0.5) / (number[0] + 1))
            if weight >= least_weight and 20 * holding[0][term] <= n and chance(n, holding[0][term], share) <= most_chance:
                weighted[term] = weight
    for term in sorted(weighted, key=len, reverse=True):
        for shorter in [term[:-1]] if len(term) > SHORTEST + 1 else []:
            if shorter in weighted and 10 * holding[1][term] >= 9 * holding[1][shorter]:
                del weighted[shorter]
    ranked = sorted(weighted.items(), key=lambda x: (-holding[1][x[0]] * x[1], x[0]))
    lexicon = Lexicon(dict(ranked))
    automaton = matcher(lexicon)
    around: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for folded, label in rows:
        pairs = set()
        for start, _ in hits(folded, automaton, set()):
            stop = folded.index(" ", start + 1)
            word = folded[start + 1 : stop]
            pairs |= {(folded[:start].rpartition(" ")[2], word), (word, folded[stop + 1 :].partition(" ")[0])}
        around[label].update(pairs)
    lexicon.exceptions = {p for p, n in around[0].items() if n >= 3 and not around[1][p] and all(p)}
    x = np.array([(1.0, *measures(f, hits(f, automaton, lexicon.exceptions))) for f, _ in rows]).reshape(-1, 3)
    y = np.array([label for _, label in rows], float)
    line = np.array([-3.0, 1.0, 0.5])
    for _ in range(25 if len(rows) else 0):  # Newton's method, held back by a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * line
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        line = line - np.linalg.solve(curve, slope)
    lexicon.line = tuple(float(v) for v in line)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1), n_words, and hits as (word number, weight).

    Only doc_id and text are read and only text counts; the whole text does.  The weight of all hits
    and their weight per 100 words give the score.  NULL and empty texts have no hits.  Equal texts get
    equal results; tables without rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        lexicon = sent.value
        automaton = matcher(lexicon)
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "score": [], "n_words": [], "hits": []}
            for text in batch["text"]:
                folded = fold((text or b"").decode("utf-8", "replace"))
                found = hits(folded, automaton, lexicon.exceptions)
                out["score"].append(_score(measures(folded, found), lexicon.line))
                out["n_words"].append(max(folded.count(" ") - 1, 0))
                out["hits"].append([{"word": folded.count(" ", 0, at), "weight": w} for at, w in found])
            yield out

    return arrow_rows(
        docs.select(docs["doc_id"].cast("long"), "text"),
        each,
        "doc_id long, score double, n_words long, hits array<struct<word: long, weight: double>>",
    )
