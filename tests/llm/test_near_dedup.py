import random

from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm.common import components
from tidemark.llm.near_dedup import keep_one, near_duplicates


def brute(rows, width):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def variants(n, length, edits, seed):
    r = random.Random(seed)
    base = words(seed * 1000, length).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_equals_brute_force(docs):
    texts = variants(60, 120, 9, 1) + variants(30, 40, 3, 2) + variants(20, 9, 2, 3) + [words(9, 500)] * 3
    texts += ["", None, " ", "one", "one", "ONE", "one two", words(9, 500) + " tail"]
    rows = [(i * 7 % 997, t) for i, t in enumerate(texts)] + [(5000, "same id"), (5000, words(9, 500)), (5001, "same id")]
    got = near_duplicates(docs(rows), width=4, block=16)
    expected = brute(rows, 4)
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {r.n_shingles for r in found if r.doc_id == rows[113][0]} == {0}


def test_rows_without_id_or_text(docs):
    rows = [(None, words(0, 30)), (1, words(0, 30)), (2, words(0, 30)), (None, None), (3, None), (4, "")]
    found = near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)] * 2
    assert near_duplicates(docs(rows).limit(0)).count() == 0


def test_one_of_each_group_stays(docs):
    rows = [(3, words(0, 30)), (1, words(0, 30)), (1, words(0, 30)), (2, "other"), (None, "x"), (4, None)]
    df = docs(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]


def test_components(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    star = spark.range(1001, 1100).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.id: r.component for r in components(chain.union(star)).collect()}
    assert got == {i: 0 for i in range(200)} | {i: 1000 for i in range(1000, 1100)}
    assert components(chain.limit(0)).count() == 0
