"""Collocations against a count of every phrase."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as module
from tidemark.llm.collocations import Settings, collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, settings, k):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, settings.longest + 1) for i in range(len(w) - m + 1))
    frequent = {key: a for key, a in f.items() if a >= settings.least and len(key[1]) > 1}
    covered = set()
    for (lang, p), a in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if a >= f[lang, p[i : i + m]]:
                    covered.add((lang, p[i : i + m]))
    found = {}
    for (lang, p), a in frequent.items():
        if (lang, p) in covered:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        row = (-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]])
        found.setdefault(lang, []).append(row)
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s)
        for lang, of_lang in found.items()
        for i, (s, a, p, l, r) in enumerate(sorted(of_lang)[:k], 1)
    )


def texts(rng, n):
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.6, rng.integers(0, 80)) if x < 40]
        for at in range(3, len(words), 9):
            words[at : at + 1] = [["New York City hall"], ["a b a b a"], ["\xc9tat-major, x."], ["q\tq  q"]][i % 4]
        out.append((["en", "de", None][i % 3], " ".join(words)))
    return out


@pytest.mark.parametrize(
    "settings", [Settings(5, 4, 4), Settings(4, 4, 2, cells=2), Settings(5, 6, 3, cells=16, together=500), Settings(3, 2, 1)]
)
def test_equals_loops(spark, settings):
    """With a filter of few cells too, which takes most phrases for frequent."""
    rows = [*texts(np.random.default_rng(settings.shards), 90), ("en", None), ("en", ""), ("de", " ..,, \n"), ("fr", "new york " * 9)]
    docs = spark.createDataFrame([(i, lang, t, "x", 0) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    found = collocations(docs.repartition(3), settings, 7)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows, settings, 7)


def test_long_texts_are_read_in_stretches(spark):
    rows = [("en", "red green blue " * 3000), ("en", "red green"), (None, "x y")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    settings = Settings(4, 5, 2, together=10)
    assert sorted(map(tuple, collocations(docs, settings).collect())) == brute(rows, settings, 2000)


def test_rare_pairs_of_frequent_words_are_not_counted_one_by_one(spark, monkeypatch):
    """All words are frequent and only one pair is: no other pair gets into the tables of counts."""
    numbers = np.random.default_rng(5).integers(0, 60, (40, 100))
    rows = [("en", " ".join(f"w{x}" for x in of_text) + ". new york") for of_text in numbers.tolist()]
    pairs, write = [], module.shared_table

    def watched(df, name, by=None):
        out = write(df, name, by)
        if "/step" in name:
            pairs.extend(r.phrase for r in out.filter("words = 2").collect())
        return out

    monkeypatch.setattr(module, "shared_table", watched)
    docs = spark.createDataFrame(rows, "lang string, text string")
    settings = Settings(3, 20, 2)
    assert sorted(map(tuple, collocations(docs, settings).collect())) == brute(rows, settings, 2000)
    assert set(pairs) == {"new york"}


@pytest.mark.parametrize("pairs", [8, 64])
def test_few_cells_for_pairs(spark, pairs):
    """Pairs that share cells are told apart, and wide numbers are read as they were written."""
    rows = texts(np.random.default_rng(7), 60) + [("en", " ".join(f"v{i}" for i in range(70_000)))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    settings = Settings(4, 4, 2, pairs=pairs)
    assert sorted(map(tuple, collocations(docs, settings).collect())) == brute(rows, settings, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores of large counts are exact."""
    f = [("x", 1, "p", 9_000_000_000_001), ("x", 1, "q", 7_000_000_000_003), ("x", 2, "p q", 6_000_000_000_000), ("x", 0, "", 10**14)]
    frame = spark.createDataFrame(f, "lang string, words int, phrase string, f long")
    monkeypatch.setattr(module, "frequent_phrases", lambda docs, settings: frame)
    row = collocations(spark.createDataFrame([], "lang string, text string")).first()
    n = sum(x[3] for x in f if x[1] < 2)
    assert row.score == 1000 * f[2][3] * n // (f[0][3] * f[1][3])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).collect() == [] and collocations(docs).columns == COLUMNS
