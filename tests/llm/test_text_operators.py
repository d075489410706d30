"""Page text, repeated passages, language, toxicity and quality on small rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import html_text, labelled, language_id, quality_classifier, suffix_dedup, toxicity

PAGES = [
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x<p>y</ol>after", "3. x\n\n   y\n\nafter"),
    ("<p>hi<p>there<div hidden>no</div><span style='color:red; display: none'>no</span>", "hi\n\nthere"),
    ("<table><tr><th>x<th>yy<tr><td>long cell<td>1</table><p>end", "x         | yy\nlong cell | 1\n\nend"),
    ("<table><td>a<td>b<br>c</table>", "a | b\n  | c"),
    ("<html><head><title>t</title><style>s</style></head><body>x<script>var t='</p>';</script> y</body></html>", "x y"),
    ("a<pre> 1\n  2</pre>b", "a\n\n 1\n  2\n\nb"),
    ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
    ("<div>a</div><div>b <b>c</b>  d</div>&amp;&nbsp;&lt;", "a\nb c d\n&\xa0<"),
    ("</p></table><td>loose<li>item", "loose\n- item"),
    ("", ""),
    ("<!-- x --><p></p>", ""),
    ("<dl><dt>t<dd>d<dt>u</dl><h1>h</h1>", "t\nd\nu\n\nh"),
    ("<p>unclosed <b>bold <i>both", "unclosed bold both"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_render(html, text):
    assert html_text.render(html) == text


def test_pages(spark):
    df = spark.createDataFrame([(i, p, "u", "old") for i, (p, _) in enumerate(PAGES)] + [(None, None, "u", None)], "page_id long, html string, url string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert {r.page_id: r.text for r in got.collect()} == {i: t for i, (_, t) in enumerate(PAGES)} | {None: None}
    assert html_text.extract(df.limit(0)).count() == 0
    assert html_text.render("<div>" * 30_000 + "deep <table>" * 2000).startswith("deep")


def test_repeated_passages_equal_brute_force(docs):
    r = random.Random(5)
    passage = [words(1000 * k, 50 + k * 7) for k in range(6)]
    rows = []
    for i in range(120):
        parts = [words(10**6 + i * 1000, r.randrange(60))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passage), words(10**7 + i * 1000 + r.randrange(900), r.randrange(30))]
        rows.append((i, " ".join(parts)))
    rows += [(500, words(5 * 10**6, 49)), (501, words(5 * 10**6, 49)), (502, words(0, 60) + " " + words(0, 60)), (503, None), (504, "")]
    rows += [(None, passage[0]), (505, words(77, 200)), (505, words(77, 200)), (506, "x " * 300), (507, "x " * 300), (508, "y z " * 15_000), (509, "y z " * 6_000)]
    places = defaultdict(set)
    texts = [(i, (t or "").split()) for i, t in rows if i is not None]
    for i, w in texts:
        for p in range(len(w) - 49):
            places[hash(tuple(w[p : p + 50]))].add(i)
    expected = defaultdict(set)
    for i, w in texts:
        for p in range(len(w) - 49):
            if len(places[hash(tuple(w[p : p + 50]))]) > 1:
                expected[i] |= set(range(p, p + 50))
    got = suffix_dedup.repeated_passages(docs(rows)).collect()
    assert {r.doc_id: {x for s in r.spans for x in range(s["from"], s["to"])} for r in got} == dict(expected)
    assert suffix_dedup.repeated_passages(docs(rows).limit(0)).count() == 0


def shared_words(rows, least=50):
    """By brute force: words of each document that lie in passages another one has too."""
    texts, places, expected = [(i, t.split()) for i, t in rows], defaultdict(set), defaultdict(set)
    for i, w in texts:
        for p in range(len(w) - least + 1):
            places[tuple(w[p : p + least])].add(i)
    for i, w in texts:
        for p in range(len(w) - least + 1):
            if len(places[tuple(w[p : p + least])]) > 1:
                expected[i] |= set(range(p, p + least))
    return dict(expected)


def found_words(docs, rows):
    got = suffix_dedup.repeated_passages(docs(rows)).collect()
    return {r.doc_id: {x for s in r.spans for x in range(s["from"], s["to"])} for r in got}


def phrases_in_passages(others):
    """Passages of 50 words that two documents share, around phrases of 36 words that ``others`` more have."""
    r, rows = random.Random(6), []
    for k in range(30):
        before, phrase = words(1000 * k, 14), words(1000 * k + 500, 36)
        for j in range(others + 2):
            around = [" ".join(f"v{r.randrange(10**9)}" for _ in range(25)) for _ in range(3)]
            rows.append((len(rows), " ".join([around[0], around[2] if j > 1 else before, phrase, around[1]])))
    return rows


@pytest.mark.parametrize("distance", [1, 2, 4, 5, 7, 10])
def test_exchanged_words_are_no_repetition(docs, distance):
    """Words in exchanged places must not make up for each other in the hash of a passage."""
    rows = []
    for i in range(12):
        base = [f"t{i}x{j}" for j in range(60)]
        for doc, order in enumerate(("pqqp", "qppq")):
            mine = list(base)
            for at, sign in enumerate(order):
                mine[18 + at * distance if distance < 10 else 12 + at * distance] = f"{sign}{i}"
            rows.append((2 * i + doc, " ".join(mine)))
    assert suffix_dedup.repeated_passages(docs(rows)).collect() == []


def test_passages_around_a_frequent_phrase(docs):
    rows = phrases_in_passages(8)
    expected = shared_words(rows)
    assert len(expected) == 60
    assert found_words(docs, rows) == expected


def test_passages_across_groups_of_a_frequent_head(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    r, rows = random.Random(7), phrases_in_passages(10)
    for _ in range(40):  # of one phrase, in documents that share from 31 to 70 words around it
        whole = words(10**6, 70).split()
        start, stop = r.randrange(20), 70 - r.randrange(20)
        rows.append((len(rows), f"a{r.random()} {' '.join(whole[start:stop])} b{r.random()}"))
    rows += [(1000, "x " * 300), (1001, "x " * 70), (1002, "x " * 50), (1003, "x " * 49), (1004, "x " * 90)]
    assert found_words(docs, rows) == shared_words(rows)


LANGUAGES = {"aa": "the then that this with other there", "bb": "der die das und nicht ein eine", "cc": "été écran élan où ça"}


def learned():
    return language_id.learn([(t.encode(), n) for n, t in LANGUAGES.items() for _ in range(3)])


def brute_bits(word, text):
    tree = defaultdict(Counter)
    for w, n in Counter(language_id.words_of(text) * 3).items():
        s = b" " + w + b" "
        for o in range(language_id.ORDER + 1):
            for j in range(max(o, 1), len(s)):
                tree[s[j - o : j]][s[j]] += n
    s, bits = b" " + word + b" ", 0.0
    for j in range(1, len(s)):
        o = min(language_id.ORDER, j)
        while o >= 0 and not tree.get(s[j - o : j], {}).get(s[j]):
            if c := tree.get(s[j - o : j]):
                bits += math.log2((sum(c.values()) + len(c)) / len(c))
            o -= 1
        c = tree.get(s[j - o : j]) if o >= 0 else None
        bits += math.log2((sum(c.values()) + len(c)) / c[s[j]]) if c else 8
    return bits


def test_code_lengths_are_exact():
    tables = learned()
    tested = [w.encode() for w in ("the", "thin", "zz", "t", "étéx", "nichtt", "ß")]
    got = language_id.code_lengths(tested, tables)
    for w, bits in zip(tested, got, strict=True):
        assert list(bits) == pytest.approx([brute_bits(w, LANGUAGES[n]) for n in tables.languages])


def test_languages(docs):
    rows = [(1, "this then"), (2, "UND DIE"), (3, None), (4, "12 !!"), (5, ""), (6, "Été"), (None, "nicht das"), (1, "this then"), (7, "that " * 20_000)]
    got = language_id.identify(docs(rows), learned(), at_once=2).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [
        (0, "bb"), (1, "aa"), (1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "cc"), (7, "aa"),
    ]
    assert all(0 <= r.score <= 1 for r in got)
    none = language_id.identify(docs(rows), language_id.learn([])).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs(rows).limit(0), learned()).count() == 0


def test_language_rows_are_bounded(spark):
    df = spark.createDataFrame([(i, "x", "aa" if i % 3 else "bb") for i in range(300)] + [(7, None, "aa"), (8, "x", None)], "doc_id long, text string, lang string")
    got = language_id.sample(df, labelled.remainder(F.col("doc_id"), 4) != 2, 20)
    assert Counter(n for _, n in got) == {"aa": 20, "bb": 20}


def test_folding():
    assert toxicity.fold("You Ι d1ot, m0r0n! Іd10t (s.c.u.m) 1234 ＩＤＩＯＴ") == " you i diot moron idiot scum 1234 idiot "
    assert toxicity.fold(" \n") == "" == toxicity.fold("")


def labelled_texts(n=400):
    r = random.Random(3)
    plain = words(0, 200).split()
    rows = []
    for i in range(n):
        text = [r.choice(plain) for _ in range(r.randrange(30, 200))]
        if i % 4 == 0:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "m0ron", "Scum!"]))
        elif i % 4 == 1:
            text += ["happy", "clown", "fish"]
        rows.append((" ".join(text).encode(), int(i % 4 == 0)))
    return rows


def test_toxicity(docs):
    lexicon = toxicity.learn(labelled_texts())
    assert {" idiot ", " moron ", " scum "} <= set(lexicon.terms)
    rows = [(1, words(0, 50) + " IDIOT idi0t scum"), (2, words(0, 80)), (3, None), (4, ""), (None, "moron moron"), (2, words(0, 80)), (5, words(0, 20_000))]
    got = toxicity.score(docs(rows), lexicon).collect()
    score = {r.doc_id: r.score for r in got}
    assert score[1] > 0.7 and score[None] > 0.7 and max(score[2], score[3], score[4], score[5]) < 0.3 and len(got) == len(rows)
    assert [h["word"] for h in next(r for r in got if r.doc_id == 1).hits] == [50, 51, 52]
    assert toxicity.learn([]).terms == {} and toxicity.score(docs(rows).limit(0), lexicon).count() == 0


def test_terms_of_a_small_language():
    r = random.Random(8)
    small = words(5000, 60).split()
    rows = labelled_texts(2000)
    for i in range(160):  # 8 of about 510 toxic rows: under 2%
        text = r.choices(small, k=40)
        rows.append((" ".join(text + ["cretino"] * (i % 20 == 0)).encode(), int(i % 20 == 0)))
    lexicon = toxicity.learn(rows)
    assert {" idiot ", " cretino "} <= set(lexicon.terms)
    assert toxicity.hits(toxicity.fold("w5001 Cretino w5002"), toxicity.matcher(lexicon), lexicon.exceptions)
    assert not any(term.startswith(" w") for term in lexicon.terms)
    assert toxicity.chance(3, 0, 0.5) == pytest.approx(0.125) and toxicity.chance(1, 1, 0.5) == pytest.approx(0.75)
    few = [(b"odd1 x", 1)] * 6 + [(b"x", 1)] * 94 + [(b"x", 0)] * 100  # 6 of 6 at even odds may be chance
    assert toxicity.learn(few).terms == {}


def test_exceptions():
    lexicon = toxicity.Lexicon({" clown ": 3.0}, {("clown", "fish")})
    automaton = toxicity.matcher(lexicon)
    assert toxicity.hits(toxicity.fold("a clown fish"), automaton, lexicon.exceptions) == []
    assert len(toxicity.hits(toxicity.fold("a clown"), automaton, lexicon.exceptions)) == 1


def test_quality(docs):
    r = random.Random(4)
    plain = words(0, 300).split()
    text = lambda bad: " ".join(r.choice(plain) + ("%%%" if bad else "") for _ in range(r.randrange(20, 120)))
    model = quality_classifier.train([(text(i % 3 == 0).encode(), int(i % 3 != 0)) for i in range(300)])
    rows = [(i, text(i % 2)) for i in range(100)] + [(200, None), (201, ""), (None, text(0)), (202, text(1) * 200), (0, text(0))]
    got = quality_classifier.score(docs(rows), model, at_once=7).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert np.mean([(x.score >= 0.7) == (x.doc_id % 2 == 0) for x in got if x.doc_id is not None and x.doc_id < 100]) > 0.97
    assert len({x.score for x in got if x.doc_id in (200, 201)}) == 1
    assert quality_classifier.score(docs(rows).limit(0), model).count() == 0
    assert quality_classifier.Scorer(quality_classifier.train([]))([b"a b", None])[1] == 0.5


def test_samples(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs([(i, f"t{i}") for i in range(50)] + [(3, None)])
    got = labelled.sample(df, labels, "quality", labelled.remainder(F.col("doc_id"), 4) != 2, 20)
    assert len(got) == len(set(got)) == 20 and all(int(t[1:]) % 2 == y for t, y in got)
    assert all(zlib.crc32(t[1:]) % 4 != 2 for t, _ in got)
    assert labelled.sample(df, labels, "toxic", F.lit(True), 5) == []
