"""Ranked search against plain loops over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical_search
from tidemark.llm.lexical_search import Shape, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in terms(text)
                if t in bag
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=repr)


def corpus(rng, n, vocabulary):
    shares = 1 / np.arange(1, vocabulary + 1)
    return [
        (i, " ".join(f"T\xe9rm{x}" for x in rng.choice(vocabulary, rng.integers(1, 60), p=shares / shares.sum())))
        for i in range(n)
    ]


@pytest.mark.parametrize("shape,at_once", [(Shape(leaf=1), 16384), (Shape(100, 300, 4, 2), 40), (Shape(), 16384)])
def test_equals_loops(spark, shape, at_once):
    rng = np.random.default_rng(shape.leaf)
    rows = [*corpus(rng, 300, 80), (None, "t\xe9rm1 t\xe9rm50"), (7, "T\xc9RM3 T\xe9rm70, t\xe9rm70"), (500, None), (501, " .,; ")]
    rows += [(900 + i, "T\xe9rm5 T\xe9rm60 zz") for i in range(70)]  # many equal scores
    items = [(i, t) for i, t in corpus(rng, 12, 80)] + [(3, "zz ZZ"), (None, "t\xe9rm60"), (20, None), (21, "-"), (22, "absent")]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, score long, rank string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 5):
        found = search(docs.repartition(3), asked, k, at_once, shape)
        assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(rows, items, k)


def test_very_long_text_and_repeated_rows(spark):
    rows = [(1, "rain " * 200_000 + "sun")] + [(2, "sun")] * 3 + [(3, "rain")]
    items = [("a", "sun rain"), ("a", "sun")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = search(docs, spark.createDataFrame(items, "item_id string, text string"), 20)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, items, 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(none, items).collect() == [] == search(some, items.limit(0)).collect()
    assert search(none, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_branches_are_left_out(monkeypatch):
    """The tree must not score every document."""
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, 50, 12)) for _ in range(400)]
    lists[17] = np.array([7, 48, 49])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ranks = np.concatenate(lists)
    counts = np.ones(len(ranks), np.int32)
    tree = lexical_search.Tree(np.arange(400), np.zeros(400, bool), np.full(400, 100), starts, ranks, counts, 50, Shape(leaf=8))
    scored = []
    plain = np.cumsum
    monkeypatch.setattr(lexical_search.np, "cumsum", lambda x: scored.append(len(x)) or plain(x))
    weights = np.zeros(50, np.int64)
    weights[[7, 48, 49]] = [1, 100, 100]
    query = lexical_search.Query(0, 0, np.array([7, 48, 49]), np.ones(3, np.int64))
    best = tree.search(query, weights, [], 1)
    assert best[0][0] == -201 * lexical_search.part_of(np.array(1), np.array(100))
    assert sum(scored) < 0.8 * len(ranks)
