"""Long passages that repeat across documents, by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut
from tidemark.llm.near_dedup import FACTORS, WordHashes


@dataclass(frozen=True)
class Shape:
    """Lengths in words.

    Of every ``window`` neighbouring ``gram``-word sequences the one with the smallest hash marks a
    suffix to retain.  A match of ``least`` words thus has a retained suffix among its first
    ``window`` words, with ``head`` words of the match at least from there on.
    """

    least: int = 50
    gram: int = 8
    window: int = 20

    @property
    def head(self) -> int:
        return self.least - self.window + 1


#: Documents that share the head of a suffix are compared in groups of about this many, and these groups by key.
GROUP = 4000
#: A head is frequent if one in so many retained suffixes has it.
FREQUENT = 1000


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(27))


def _place_factors(width: int) -> np.ndarray:
    """An odd factor for each place of a sequence, unrelated to those of other places."""
    return _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(FACTORS[0])) | np.uint64(1)


def _sequences(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of ``width`` words, in which exchanged words do not make up for each other."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, factor in enumerate(_place_factors(width)):
        out += codes[i : i + n] * factor
    return _mixed(out)


def _codes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def retained(codes: np.ndarray, shape: Shape) -> np.ndarray:
    """Places of the suffixes to retain: window minima of the gram hashes, with a whole head after them."""
    grams = _sequences(codes, shape.gram)
    if not len(grams):
        return np.empty(0, np.int64)
    width = min(shape.window, len(grams))
    lanes = np.lib.stride_tricks.sliding_window_view(grams, width)
    places = np.unique(lanes.argmin(axis=1) + np.arange(len(lanes)))
    return places[places + shape.head <= len(codes)]


def _heads(docs: DataFrame, shape: Shape) -> DataFrame:
    """Per retained suffix: doc_id, place, a hash of its head, and whether its text has the head first here."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            ids, keys, places, firsts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                codes = _codes(text, hashes)
                at = retained(codes, shape)
                if len(at):
                    ids.append(np.full(len(at), doc_id, np.int64))
                    places.append(at.astype(np.int32))
                    head = _sequences(codes, shape.head)[at].view(np.int64)
                    keys.append(head)
                    first = np.zeros(len(at), bool)
                    first[np.unique(head, return_index=True)[1]] = True
                    firsts.append(first)
            if ids:
                parts = {"doc_id": ids, "place": places, "head": keys, "first": firsts}
                yield {name: np.concatenate(part) for name, part in parts.items()}

    return arrow_rows(docs, each, "doc_id long, place int, head long, first boolean")


def _suffixes(docs: DataFrame, shape: Shape) -> DataFrame:
    """Per retained suffix that is listed in ``places``: the words right of its head and left of it.

    Both are sequences of 4-byte word hashes, those on the left read backwards, as long as a match
    may have to be followed.  Places of a text with equal words on both sides share a row.
    """
    right = left = shape.least - shape.head

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("head", "salt", "right", "left", "doc_id", "places")}
            for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
                small = (_codes(text, hashes) >> np.uint64(32)).astype(">u4")
                alike: dict[tuple, list[int]] = {}
                for p in places:
                    end = p["place"] + shape.head
                    before = small[max(0, p["place"] - left) : p["place"]][::-1].tobytes()
                    alike.setdefault((p["head"], p["salt"], small[end : end + right].tobytes(), before), []).append(p["place"])
                for key, at in alike.items():
                    for name, value in zip(out, (*key, doc_id, at), strict=True):
                        out[name].append(value)
            yield out

    return arrow_rows(docs, each, "head long, salt int, right binary, left binary, doc_id long, places array<int>")


def _sums(sides: list[bytes], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of 4-byte hashes: a hash of every beginning, the empty one first, and their lengths."""
    width = len(factors)
    padded = b"".join(s[: 4 * width].ljust(4 * width, b"\0") for s in sides)
    values = np.frombuffer(padded, ">u4").reshape(-1, width).astype(np.uint64) * factors
    sums = np.zeros((len(sides), width + 1), np.uint64)
    np.cumsum(values, axis=1, out=sums[:, 1:])
    return sums, np.fromiter(map(len, sides), np.int64, len(sides)) // 4


def group_matches(rows: dict[str, list], shape: Shape) -> dict[str, list]:
    """Matches in whole groups of suffixes (head, salt, right, left, doc_id, places): doc_id, from, to, key, salt.

    A passage of ``least`` words that contains a head is that head, some words left of it and the
    others right of it.  All such passages of every suffix are keyed, so that each key of two
    documents is found, whatever lies between them in any order.  What a suffix shares contains its
    head, so its passages join into one span.

    These rows have no key.  A head with a salt has other groups too: each passage that one
    document of this group has comes with its key, to be a match if another group has the key;
    keys of several documents come once, without doc_id.
    """
    out: dict[str, list] = {c: [] for c in ("doc_id", "from", "to", "key", "salt")}

    def add(*values: int | None) -> None:
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)

    if not rows["head"]:
        return out
    span = shape.least - shape.head
    factors = _place_factors(2 * span + 3)
    left, n_left = _sums(rows["left"], factors[:span])
    right, n_right = _sums(rows["right"], factors[span : 2 * span])
    head, salt, doc = (np.array(rows[c], np.int64) for c in ("head", "salt", "doc_id"))
    offsets = np.arange(span + 1)  # words left of the head
    keys = left + right[:, ::-1] + offsets.astype(np.uint64) * factors[2 * span]
    keys = _mixed(keys + (head.view(np.uint64) * factors[2 * span + 1])[:, None])
    whole = (offsets <= n_left[:, None]) & (span - offsets <= n_right[:, None])
    row, offset = np.nonzero(whole)
    if not len(row):
        return out
    inside = keys[row, offset] + salt.view(np.uint64)[row] * factors[2 * span + 2]
    order = np.argsort(inside, kind="stable")
    row, offset, inside = row[order], offset[order], inside[order]
    starts = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    several = np.minimum.reduceat(doc[row], starts) < np.maximum.reduceat(doc[row], starts)
    shared = np.zeros_like(whole)
    shared[row, offset] = np.repeat(several, np.diff(np.append(starts, len(row))))
    least, most = shared.argmax(axis=1), span - shared[:, ::-1].argmax(axis=1)
    for i in np.flatnonzero(shared.any(axis=1)).tolist():
        for place in rows["places"][i]:
            add(int(doc[i]), place - int(most[i]), place - int(least[i]) + shape.least, None, None)
    if (salt >= 0).any():
        for j in starts[several & (salt[row[starts]] >= 0)].tolist():
            add(None, None, None, int(keys[row[j], offset[j]].view(np.int64)), int(salt[row[j]]))
        for i, o in zip(*(x.tolist() for x in np.nonzero(whole & ~shared & (salt >= 0)[:, None])), strict=True):
            for place in rows["places"][i]:
                add(int(doc[i]), place - o, place - o + shape.least, int(keys[i, o].view(np.int64)), int(salt[i]))
    return out


def _matches(suffixes: DataFrame, shape: Shape) -> DataFrame:
    """Bring the suffixes of each head together and find what they share."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        rows: dict[str, list] = {c: [] for c in ("head", "salt", "right", "left", "doc_id", "places")}
        for batch in batches:
            for name, values in rows.items():
                values.extend(batch[name])
            at = len(rows["head"])
            if not at:
                continue
            last = rows["head"][-1], rows["salt"][-1]
            while at and (rows["head"][at - 1], rows["salt"][at - 1]) == last:
                at -= 1
            if at:  # all groups but the last one are whole
                yield group_matches({name: values[:at] for name, values in rows.items()}, shape)
                rows = {name: values[at:] for name, values in rows.items()}
        yield group_matches(rows, shape)

    dealt = suffixes.repartition("head", "salt").sortWithinPartitions("head", "salt")
    return arrow_rows(dealt, each, "doc_id long, from int, to int, key long, salt int")


def repeated_passages(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per document that shares a passage of ``shape.least`` words or more: doc_id and spans.

    Words stand between blanks and are compared as they are; spans are (from, to) in words, to not
    included, joined where they meet, in order.  A passage counts if another document (doc_id) has
    it too; one that repeats only within its document does not.  A document's own rows count as one
    document.

    Suffixes are retained at minimisers and brought together by head; all passages of ``least`` words
    that contain the head are compared, so that what documents share is found whole whatever stands
    around it.  A head that more than ``GROUP`` documents have is dealt by document into groups of
    about that many, so no task holds all of a common passage; passages that only one document of
    its group has are then compared across groups by key.  Rows without doc_id or text, and texts
    of fewer words, have no spans; tables without rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    heads = cut(_heads(rows, shape))
    shared = cut(
        heads.groupBy("head")
        .agg(F.count_if("first").alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        .filter("x < y")
        .select("head", "n")
    )
    # -1: all documents of the head are in one group.
    salt = F.when(F.col("n") <= GROUP, -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / GROUP))).cast("int")
    # A head with a thousandth of all suffixes is one of a thousand at most: these are broadcast, so
    # that a passage which many documents share does not meet in one task.
    frequent = shared.filter(F.col("n") * FREQUENT >= heads.count())
    heads = heads.drop("first")
    met = heads.join(F.broadcast(frequent), "head").unionByName(
        heads.join(F.broadcast(frequent.select("head")), "head", "left_anti").join(shared, "head")
    )
    places = (
        met
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("place", "head", salt.alias("salt"))).alias("places"))
    )
    found = cut(_matches(_suffixes(rows.join(places, "doc_id"), shape), shape))
    keyed = found.filter("key IS NOT NULL")
    across = keyed.groupBy("key").agg(F.min("salt").alias("x"), F.max("salt").alias("y")).filter("x < y").select("key")
    found = (
        found.filter("key IS NULL")
        .unionByName(keyed.filter("doc_id IS NOT NULL").join(across, "key").select(*found.columns))
        .select("doc_id", "from", "to")
    )
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("s"))
    joined = F.aggregate(
        "s",
        F.array().cast("array<struct<from: int, to: int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["from"] <= F.element_at(done, -1)["to"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["from"].alias("from"),
                        F.greatest(F.element_at(done, -1)["to"], s["to"]).alias("to"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return spans.select("doc_id", joined.alias("spans"))
