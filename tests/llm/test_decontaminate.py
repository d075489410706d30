import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import words
from tidemark.llm.decontaminate import compile_patterns, contamination, keep_clean, normal, occurrences, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, width=13):
    w = WORD.findall(lower(text))
    hit, names = set(), set()
    for name, item in items:
        v = WORD.findall(lower(item))
        take = min(width, len(v))
        for k in range(len(v) - take + 1) if v else ():
            for i in range(len(w) - take + 1):
                if w[i : i + take] == v[k : k + take]:
                    hit |= set(range(i, i + take))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)


ITEMS = [(1, words(0, 30)), (2, "Short ITEM"), (3, "é"), (4, None), (5, "--"), (None, words(50, 13)), (7, words(0, 30)), (10, words(5, 20))]
TEXTS = [
    None, "", "...", words(0, 30), words(3, 13).upper().replace(" ", ", "), words(3, 12), "a short item, and É é", "x " * 40 + words(8, 14) + " y" * 400,
    words(50, 13), words(100, 5000) + " short item", "short-item short\nitem short", words(8, 14) + " " + words(8, 14), "shortitem", words(8, 14),
]


def test_equals_brute_force(spark, docs):
    df = docs([*enumerate(TEXTS), (0, TEXTS[3])])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block_bytes in (8 << 20, 64):
        got = contamination(df, items, block_bytes=block_bytes)
        assert set(df.columns) - {"n_words"} < set(got.columns)
        found = got.collect()
        assert len(found) == len(TEXTS) + 1
        for r in found:
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(r.text, ITEMS), r.text
            assert sum(s["to"] - s["from"] for s in r.spans) == r.n_hit


def test_nothing_to_search(spark, docs):
    df = docs(enumerate(TEXTS))
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in contamination(df, none).collect()} == {(0, False)}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(df.limit(0), items).count() == 0
    kept = keep_clean(df, items)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[3]}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_search_finds_every_occurrence(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "ab", "ba", "bab", "x1", "é"]) for _ in range(n))
    texts = [normal(text(r.randint(0, 900)).encode()) for _ in range(4)]
    patterns = {p: i for i, p in enumerate(dict.fromkeys(w for n in (1, 2, 3, 9, 20) for w in windows(normal(text(n).encode()), 13)))}
    expected = {
        (t, i, i + len(p), k) for t, plain in enumerate(texts) for p, k in patterns.items()
        for i in range(len(plain)) if plain.startswith(p, i)
    }
    assert set(occurrences(texts, compile_patterns(patterns))) == expected
