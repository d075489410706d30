import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm.quality_rules import _windows_as_text, ablations, keep_passing, ledger, mask_of, passes


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {p for i, x in enumerate(windows) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (5, "a a a a a"), (6, "x\nx\n\n y\ny"), (7, words(0, 60)),
    (8, "<b> #1 & 𝒳é | $"), (9, " ".join(["a b c"] * 30)), (9, " ".join(["a b c"] * 30)), (None, "only one"),
    (10, words(0, 20_000)), (11, " ".join(f"LOUD{chr(65 + i // 26)}{chr(65 + i % 26)}!!" for i in range(60))), (12, " \x0bq\x0cq"),
]
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measurements(docs):
    got = ledger(docs(TEXTS)).select("text", *COLUMNS).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r)[1:] == brute(r.text), r.text


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), min_size=150, max_size=150))
def test_measurements_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ledger(df).select("text", *COLUMNS).collect():
        assert tuple(r)[1:] == brute(r.text), r.text


def test_second_way_to_find_windows(spark):
    df = spark.createDataFrame([("a b c a b c".split(),), ("a b".split(),), ("a a a a".split(),)], "w array<string>")
    assert [r[0] for r in df.select(_windows_as_text(F.col("w"))).collect()] == [[0, 3], [], [0, 1]]


def test_policies_and_ablations(docs):
    rows = ledger(docs(TEXTS)).cache()
    kept = {r.doc_id for r in rows.filter(passes("v2")).collect()}
    assert kept == {7, 10}
    assert {r.doc_id for r in rows.filter(passes("base")).collect()} == {7, 10, 11}
    by_rule = {r.rule: r for r in ablations(rows, "v2").collect()}
    assert by_rule["shouting"].n_failed_alone == 1 and by_rule["repeated_words"].n_failed == 5
    assert {r.n_documents for r in by_rule.values()} == {len(TEXTS)}
    assert mask_of("base") == 3


def test_rows_keep_their_columns(docs):
    df = docs(TEXTS)
    assert keep_passing(df, "v2").columns == df.columns
    assert {r.n_words for r in keep_passing(df, "v2").collect()} == {"x"}
    assert ledger(df.limit(0)).count() == 0 and ablations(ledger(df.limit(0)), "v1").first().n_documents == 0
