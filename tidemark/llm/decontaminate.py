"""Benchmark decontamination by Wu-Manber search for many patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are in words once A-Z are lower-cased: digits, a-z and all of non-ASCII characters.
_WORD = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_GAPS = re.compile(rb"  +")
#: Texts are searched in stretches of this many bytes side by side.
STRETCH = 2048
#: Before a buffer of texts, so that eight bytes end at every place in it.
MARGIN = b" " * 8
#: Texts are searched together up to this many bytes; a longer one by itself.
TOGETHER = 16 << 20
#: Widest block, in bytes, that the shift table looks at.
BLOCK = 8


def normal(text: bytes | None) -> bytes:
    """Words of a text with one space before, between and after; empty if it has none."""
    spaced = _GAPS.sub(b" ", (text or b"").lower().translate(_WORD)).strip(b" ")
    return b" " + spaced + b" " if spaced else b""


def windows(item: bytes, width: int) -> list[bytes]:
    """All windows of ``width`` words of a normal text, or the text itself if it is shorter."""
    words = item.split()
    if not words:
        return []
    take = min(width, len(words))
    return [b" " + b" ".join(words[i : i + take]) + b" " for i in range(len(words) - take + 1)]


@dataclass
class Family:
    """Patterns of similar length with their tables.

    ``shift`` says, by the hash of a block, how far the search may move on when it sees that block:
    until the last place of the block in the first ``length`` bytes of any pattern would be
    there.  Where it says 0, ``bucket`` lists the patterns with a block of that hash at
    ``length``, which are then compared byte by byte.
    """

    patterns: list[bytes]
    numbers: list[int]
    length: int
    block: int
    bits: int
    shift: np.ndarray
    bucket: dict[int, list[int]]


def _hashes(data: bytes, ends: np.ndarray, block: int, bits: int) -> np.ndarray:
    """Hash of the block of bytes that ends before each of the given places, all 8 or more."""
    eights = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    value = eights[ends - 8] >> np.uint64(64 - 8 * block)
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def compile_patterns(patterns: dict[bytes, int]) -> list[Family]:
    """Families by length, each half as long at least as its longest pattern."""
    by_length: dict[int, list[bytes]] = {}
    for p in patterns:
        by_length.setdefault(len(p).bit_length(), []).append(p)
    families = []
    for group in by_length.values():
        length = min(map(len, group))
        block = min(BLOCK, length)
        bits = min(24, max(12, (len(group) * length).bit_length() + 2))
        shift = np.full(1 << bits, length - block + 1, np.int32)
        bucket: dict[int, list[int]] = {}
        for number, p in enumerate(group):
            ends = np.arange(block, length + 1)
            codes = _hashes(MARGIN + p[:length], ends + len(MARGIN), block, bits)
            np.minimum.at(shift, codes, (length - ends).astype(np.int32))
            bucket.setdefault(int(codes[-1]), []).append(number)
        families.append(Family(group, [patterns[p] for p in group], length, block, bits, shift, bucket))
    return families


def occurrences(texts: list[bytes], families: list[Family]) -> Iterator[tuple[int, int, int, int]]:
    """All (text, start, end, pattern number) of occurrences in normal texts.

    Texts stand one after the other in a buffer, which is divided into stretches.  These are
    searched side by side: in each round every stretch looks at one block and moves on by its
    shift.  No pattern has two spaces in a row, so none matches across texts.
    """
    buffer = MARGIN + b"".join(texts)
    begins = np.cumsum([len(MARGIN)] + [len(t) for t in texts])
    starts = np.unique(np.concatenate([begins, np.arange(len(MARGIN), len(buffer), STRETCH)]))
    for f in families:
        at = starts[:-1] + f.length  # ends of the windows now looked at
        last = np.minimum(starts[1:] + f.length - 1, len(buffer))  # ends of those that begin in the stretch
        lanes = at <= last
        at, last = at[lanes], last[lanes]
        while len(at):
            codes = _hashes(buffer, at, f.block, f.bits)
            move = f.shift[codes]
            zero = move == 0
            for end, code in zip(at[zero].tolist(), codes[zero].tolist(), strict=True):
                begin = end - f.length
                for k in f.bucket.get(code, ()):
                    if buffer.startswith(f.patterns[k], begin):
                        text = int(np.searchsorted(begins, begin, side="right")) - 1
                        start = begin - int(begins[text])
                        yield text, start, start + len(f.patterns[k]), f.numbers[k]
            at = at + np.maximum(move, 1)
            lanes = at <= last
            at, last = at[lanes], last[lanes]


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, block_bytes: int = 8 << 20
) -> DataFrame:
    """All rows and columns of ``docs``, and n_words, n_hit, items, spans and contaminated.

    Words are runs of digits, letters a-z (A-Z count as these) and non-ASCII characters.  A
    document word is hit if it lies in an occurrence of ``width`` consecutive words of an item of
    ``benchmark`` (item_id, text), or of the whole item where it has fewer.  n_hit counts these
    words, items lists the item_ids that occur (as text, sorted, each once), spans the hit
    stretches as (from, to) in words; contaminated means n_hit > 0 and n_hit at least ``percent``
    of n_words.

    The benchmark is the query set.  It is taken in blocks of ``block_bytes`` of text at most (or
    one item), each broadcast by itself and searched for in one pass after the other over the same
    rows; documents are not shuffled.  NULL texts and texts without words have no words and no
    hits, whether of documents or items; items without item_id count as hits and are not listed;
    equal items, and rows with one item_id, are listed once.  Columns of ``docs`` with the name of a
    result are replaced.
    """
    names = ("n_words", "n_hit", "items", "spans", "contaminated")
    others = [F.col(c) for c in docs.columns if c not in (*names, "text")]
    rows = docs.select(F.struct(*(others or [F.lit(0).alias("__none")])).alias("__row"), "text")
    plain = rows.withColumn("__spans", F.lit(None).cast("array<array<int>>")).withColumn(
        "__items", F.lit(None).cast("array<string>")
    )
    for block in _blocks(benchmark, block_bytes):
        plain = _searched(plain, block, width)
    counted = plain if "n_words" in plain.columns else _searched(plain, [], width)
    return counted.select(
        *[F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns if c not in names],
        "n_words",
        "n_hit",
        F.col("__items").alias("items"),
        F.transform("__spans", lambda s: F.struct(s[0].alias("from"), s[1].alias("to"))).alias("spans"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items of the benchmark, streamed to the driver and given on in blocks of bounded size."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("text IS NOT NULL").toLocalIterator():
        text = normal(r.text.encode())
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, text))
        size += len(text)
    if block:
        yield block


def _searched(rows: DataFrame, block: list[tuple[str | None, bytes]], width: int) -> DataFrame:
    """One pass: add what a block of items hits to the spans and items found before."""
    patterns: dict[bytes, int] = {}
    items_of: list[set[str]] = []
    for item, text in block:
        for p in windows(text, width):
            if p not in patterns:
                patterns[p] = len(items_of)
                items_of.append(set())
            if item is not None:
                items_of[patterns[p]].add(item)
    sent = rows.sparkSession.sparkContext.broadcast((compile_patterns(patterns), items_of))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, items = sent.value
        for batch in batches:
            column = batch.column("text")
            texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            earlier = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            done = [
                _joined(text, hits, items, *before)
                for (text, hits), before in zip(_found(texts, families), earlier, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__row"),
                    column,
                    pa.array([d[2] for d in done], pa.list_(pa.list_(pa.int32()))),
                    pa.array([d[3] for d in done], pa.list_(pa.string())),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                ],
                names=["__row", "text", "__spans", "__items", "n_words", "n_hit"],
            )

    rows = rows.select("__row", "text", "__spans", "__items")
    return rows.mapInArrow(each, T.StructType([*rows.schema.fields]).add("n_words", "long").add("n_hit", "long"))


def _found(texts: pa.Array, families: list[Family]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Each text in normal form with its (start, end, pattern number), searched some MB at a time."""
    group: list[bytes] = []

    def searched() -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
        hits: list[list] = [[] for _ in group]
        for text, *hit in occurrences(group, families):
            hits[text].append(tuple(hit))
        yield from zip(group, hits, strict=True)

    size = 0
    for text in texts:
        plain = normal(text.as_py())
        if group and size + len(plain) > TOGETHER:
            yield from searched()
            group, size = [], 0
        group.append(plain)
        size += len(plain)
    yield from searched()


def _joined(
    plain: bytes, hits: list[tuple[int, int, int]], items_of: list[set[str]], spans: list | None, items: list | None
) -> tuple[int, int, list[list[int]], list[str]]:
    """n_words, n_hit, spans and items of one text, joined with those of earlier passes."""
    names, places = set(items or ()), {tuple(s) for s in spans or ()}
    if hits:
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        for begin, end, number in hits:
            names |= items_of[number]
            places.add((int(np.searchsorted(gaps, begin)), int(np.searchsorted(gaps, end - 1))))
    merged: list[list[int]] = []
    for a, b in sorted(places):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return max(plain.count(b" ") - 1, 0), sum(b - a for a, b in merged), merged, sorted(names)


def items_digest(items: Column) -> Column:
    """SHA-256 of sorted item_ids joined by commas, in lower-case hexadecimal."""
    return F.sha2(F.concat_ws(",", items), 256)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with their own columns alone, that are not contaminated."""
    inner = docs.select(F.struct("*").alias("__doc"), "text")
    return contamination(inner, benchmark, **settings).filter("NOT contaminated").select("__doc.*")
