"""Packing: every id in one piece, sequences without gaps, neighbours on the curve together."""

import itertools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import words
from tidemark.llm import packing
from tidemark.llm.packing import WordIds, hilbert, pack

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
ODD = [
    "don't I'LL it's '<|endoftext|>'s x<|endoftext|>y <|startoftext|>",
    "\xe9a  ́b 　x y ΣΑΣ İstanbul ŒUVRE \xd7\xf7",
    "a b​c 12.5% --'' ''s 'S \x00 \x1c\x1d a\x85b \xb2\xbd",
    "日本 １２ „Gr\xf6\xdfe“ – \xbfqu\xe9? \xabC'est\xbb",
    "***zutz%%% $#@ tail.\n\tend",
    "",
]


def test_ids_of_words_are_ids_of_texts():
    ids = WordIds(TOKENIZER.to_str())
    for text in [*ODD, words(0, 500)]:
        joined = b"".join(map(ids.__getitem__, text.encode().split()))
        assert np.frombuffer(joined, ids.dtype).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_each_word_of_a_stretch_is_looked_up_once():
    """Texts give the ids of their words, however often these occur, and empty texts none."""
    asked = []

    class Asked(WordIds):
        def of(self, found):
            asked.extend(found.to_pylist())
            return super().of(found)

    ids = Asked(TOKENIZER.to_str())
    texts = [*ODD, "", "one two one", " two\x0b\x0cone ", words(0, 300), words(0, 300)]
    flat, ends = packing._ids_of(pa.array(texts), ids)
    assert len(asked) == len(set(asked)) == len({w for t in texts for w in t.encode().split()} | {b""})
    assert any(len(run) > 1 for run in ids._runs)
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert flat[a:b].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in packing._ids_of(pa.array([], pa.string()), ids)] == [0, 0]


def test_plain_words_have_the_tokenizers_ids(monkeypatch):
    """Also where few words are remembered and those asked for together are more."""
    signs = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180), 0x2013, 0x2026, 0x201E, 0x3B1, 0x1E9E, 0x130, 0x4E00]]
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(signs[:285], rng.integers(1, 12))) for _ in range(3000)]
    some = list(dict.fromkeys([*signs, *plain, *[f"{a}{b}" for a in "aé9.'<" for b in signs]]))
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    ids = WordIds(TOKENIZER.to_str())
    for part in (some[:900], some[500:]):
        for word, found in zip(part, ids.of(pa.array(part)), strict=True):
            assert np.frombuffer(found, ids.dtype).tolist() == TOKENIZER.encode(word, add_special_tokens=False).ids


def test_stretches_hold_every_text(monkeypatch):
    texts = pa.array(["aaa", "", "b" * 50, "cc", "dd", "", "e" * 9, ""])
    monkeypatch.setattr(packing, "TOGETHER", 8)
    got = list(packing._stretches(texts))
    assert [x for _, part in got for x in part.to_pylist()] == texts.to_pylist()
    assert [start for start, _ in got] == [0, 2, 3, 6, 7]
    assert list(packing._stretches(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_step_by_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).tolist()) == {1}


def unpacked(rows, length):
    """Ids by document out of pieces, which are checked on the way."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    for number, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or (number == len(sequences) - 1 and 0 < at <= length)
    return documents


def test_every_id_is_in_one_piece(docs):
    texts = [*ODD, words(0, 700), words(5, 3), words(0, 700), None, "x"]
    rows = pack(docs(list(enumerate(texts))), VOCABULARY, length=64).collect()
    documents = unpacked(rows, 64)
    assert len(documents) == len(texts)
    for i, text in enumerate(texts):
        pieces = sorted(documents[i])
        ids = [x for _, piece, _ in pieces for x in piece]
        assert ids == [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
        assert [p[0] for p in pieces] == [0, *np.cumsum([len(p[1]) for p in pieces])[:-1].tolist()]
        assert {p[2] for p in pieces} == {len(ids)}


def test_repeated_rows_text_ids_and_empty_tables(spark):
    rows = [("a", "one two"), ("a", "one two"), ("a", "other"), (None, "x"), (None, None)] * 3
    found = pack(spark.createDataFrame(rows, "doc_id string, text string"), VOCABULARY, length=8)
    assert found.schema["doc_id"].dataType.simpleString() == "string"
    per_row = {r: len(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    got = found.collect()
    unpacked(got, 8)
    assert sum(r.length for r in got) == sum(per_row[r] for r in rows)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_like_documents_are_neighbours(docs):
    """Documents of one vocabulary lie nearer on the curve than others."""
    rng = np.random.default_rng(3)
    groups = [[f"{g}{i}" for i in range(40)] for g in ("salt", "moon", "iron", "leaf")]
    rows = [(i, " ".join(rng.choice(groups[i % 4], 60))) for i in range(200)]
    order = [r.doc_id % 4 for r in pack(docs(rows), VOCABULARY).orderBy("sequence_id", "offset").collect() if r.start == 0]
    same = np.mean([a == b for a, b in zip(order, order[1:], strict=False)])
    assert same > 0.8  # 0.25 by chance


def test_reruns_agree(docs):
    rows = docs([(i % 7, words(i % 5, 50)) for i in range(60)])
    once, again = (sorted(map(tuple, pack(rows, VOCABULARY, length=100).collect())) for _ in range(2))
    assert once == again
