"""Ranked lexical search: each query's best documents by branch and bound on a tree of term vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, top_per_group, union_all

#: Signs inside terms: digits, letters and everything beyond ASCII; capitals of ASCII count as small letters.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Queries are taken in blocks of at most so many different terms (or one query).
TERMS = 16_384


@dataclass(frozen=True)
class Shape:
    """Size of trees: documents and term entries at most (or one document), documents below which a
    branch is not divided again, and terms of a path that divide."""

    docs: int = 4096
    entries: int = 4 << 20
    leaf: int = 32
    depth: int = 48


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in order, repeats included."""
    return (text or b"").translate(_SIGNS).split()


@dataclass(frozen=True)
class Query:
    """A query in the numbers of the terms: ``terms`` and, once they are known, the weights times repeats."""

    number: int
    item_id: object
    terms: np.ndarray
    repeats: np.ndarray


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[dict[bytes, int], list[Query]]]:
    """Queries streamed to the driver, in blocks of a bounded number of terms."""
    known: dict[bytes, int] = {}
    block: list[Query] = []
    for number, r in enumerate(items.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator()):
        counts = Counter(terms(r.text.encode()))
        if not counts:
            continue
        if block and len(known.keys() | counts.keys()) > limit:
            yield known, block
            known, block = {}, []
        numbers = [known.setdefault(t, len(known)) for t in counts]
        block.append(Query(number, r.item_id, np.array(numbers), np.array(list(counts.values()))))
    if block:
        yield known, block


def restricted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Per document with a term: doc_id, its number of terms n, and the known ones with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = sent.value.get
        for batch in batches:
            column = batch.column("text")
            texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            kept, sizes, numbers, counts = [], [], [], []
            for i, text in enumerate(texts):
                found = terms(text.as_py())
                if not found:
                    continue
                kept.append(i)
                sizes.append(len(found))
                mine = np.array([t for t in map(look_up, found) if t is not None], np.int32)
                mine, times = np.unique(mine, return_counts=True)
                numbers.append(mine)
                counts.append(times.astype(np.int32))
            ends = np.cumsum([0, *map(len, numbers)]).astype(np.int32)
            flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(kept, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, flat(numbers)),
                    pa.ListArray.from_arrays(ends, flat(counts)),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Tree:
    """Term vectors of some documents as a tree of shared beginnings, most frequent terms first.

    ``ranks`` are the terms of all documents, ``starts`` where each document's begin; within a
    document they ascend.  Documents are sorted by their vectors, so every branch is a stretch of
    them.  A branch knows the largest count of each term and the least length ``m`` below it.
    """

    def __init__(
        self,
        ids: np.ndarray,
        unnamed: np.ndarray,
        m: np.ndarray,
        starts: np.ndarray,
        ranks: np.ndarray,
        counts: np.ndarray,
        n_terms: int,
        shape: Shape,
    ) -> None:
        lengths = np.diff(starts)
        paths = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        lengths = lengths[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts[order] - self.starts[:-1], lengths) + np.arange(self.starts[-1])
        self.ids, self.unnamed, self.m = ids[order], unnamed[order], m[order]
        self.ranks, counts = ranks[take], counts[take].astype(np.int64)
        self.parts = part_of(counts, np.repeat(self.m, lengths))

        place = np.arange(len(self.ranks)) - np.repeat(self.starts[:-1], lengths)
        heads = np.full((len(ids), shape.depth), -1, np.int64)
        early = place < shape.depth
        heads[np.repeat(np.arange(len(ids)), lengths)[early], place[early]] = self.ranks[early]
        self.low, self.high, self.children = [], [], []
        self._grow(heads, shape.leaf)

        self.most = np.zeros((len(self.low), n_terms), np.int64)
        self.least_m = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):  # children come after their branch
            low, high = self.low[node], self.high[node]
            self.least_m[node] = self.m[low:high].min()
            below = self.children[node]
            if below:
                self.most[node] = self.most[below].max(axis=0)
            else:
                entries = slice(self.starts[low], self.starts[high])
                np.maximum.at(self.most[node], self.ranks[entries], counts[entries])

    def _add(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self, heads: np.ndarray, leaf: int) -> None:
        """Divide stretches by the next term of their paths; small neighbours stay in one leaf."""
        todo = [(self._add(0, len(heads)), 0)]
        while todo:
            node, depth = todo.pop()
            low, high = self.low[node], self.high[node]
            while depth < heads.shape[1] and high - low > leaf and heads[low, depth] == heads[high - 1, depth] >= 0:
                depth += 1  # one common term: no division
            if depth == heads.shape[1] or high - low <= leaf or heads[high - 1, depth] < 0:
                continue
            column = heads[low:high, depth]
            edges = [low, *(np.flatnonzero(column[1:] != column[:-1]) + low + 1).tolist(), high]
            begin = low
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > leaf:
                    if begin < a:
                        self.children[node].append(self._add(begin, a))
                    self.children[node].append(self._add(a, b))
                    todo.append((self.children[node][-1], depth + 1))
                    begin = b
                elif b - begin > leaf:
                    self.children[node].append(self._add(begin, a))
                    begin = a
            if begin < high:
                self.children[node].append(self._add(begin, high))

    def search(self, query: Query, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The ``k`` best of ``best`` and the documents here, as (-score, without id, id), in order.

        Branches are entered depth first, the most promising of each division before the others; one
        that promises less than the k-th score so far is left out, one that promises as much is not,
        as ids decide between equal scores.
        """
        promise = part_of(self.most[:, query.terms], self.least_m[:, None]) @ weights[query.terms]
        stack = [0]
        while stack:
            node = stack.pop()
            least = max(1, -best[-1][0] if len(best) == k else 1)
            if promise[node] < least:
                continue
            if self.children[node]:
                stack.extend(sorted(self.children[node], key=promise.__getitem__))
                continue
            low, high = self.low[node], self.high[node]
            entries = slice(self.starts[low], self.starts[high])
            sums = np.concatenate([[0], np.cumsum(weights[self.ranks[entries]] * self.parts[entries])])
            scores = np.diff(sums[self.starts[low : high + 1] - self.starts[low]])
            good = np.flatnonzero(scores >= least)
            if len(good) > k:
                keys = (self.ids[low:high][good], self.unnamed[low:high][good], -scores[good])
                good = good[np.lexsort(keys)[:k]]
            if len(good):
                new = [(-int(scores[i]), bool(self.unnamed[low + i]), int(self.ids[low + i])) for i in good.tolist()]
                best = sorted(best + new)[:k]
        return best


def part_of(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one weight of a term counts for: more with its count, less with the document's length."""
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _searched(vectors: DataFrame, queries: list[Query], known: int, k: int, shape: Shape) -> DataFrame | None:
    """The best documents of each partition for each query of a block."""
    sums = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n, total = sums["n"], sums["l"]
    if not n:
        return None
    df = np.zeros(known, np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(known, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(known)
    ranked = [Query(q.number, q.item_id, rank[q.terms], q.repeats) for q in queries]
    by_rank = np.empty(known, np.int64)
    by_rank[rank] = weight
    sent = vectors.sparkSession.sparkContext.broadcast((ranked, by_rank, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, rank = sent.value
        best: list[list[tuple]] = [[] for _ in queries]
        mine = np.zeros(known, np.int64)
        for batch in batches:
            for some in _trees(batch, rank, n, total, known, shape):
                for i, q in enumerate(queries):
                    mine[q.terms] = weight[q.terms] * q.repeats
                    best[i] = some.search(q, mine, best[i], k)
                    mine[q.terms] = 0
        rows = [(q.number, None if none else doc, -s) for q, found in zip(queries, best, strict=True) for s, none, doc in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["number", "doc_id", "score"]
        )

    return vectors.mapInArrow(run, "number long, doc_id long, score long")


def _trees(batch: pa.RecordBatch, rank: np.ndarray, n: int, total: int, known: int, shape: Shape) -> Iterator[Tree]:
    """The documents of a batch in trees of bounded size."""
    ids = batch.column("doc_id")
    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    m = np.array([75 + (25 * size * n) // total for size in batch.column("n").to_pylist()], np.int64)
    lists = batch.column("terms")
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    ranks = rank[lists.flatten().to_numpy()]
    counts = batch.column("counts").flatten().to_numpy()
    doc = np.repeat(np.arange(len(ids)), np.diff(ends))
    order = np.lexsort((ranks, doc))
    ranks, counts = ranks[order], counts[order]
    low = 0
    while low < len(ids):
        high = int(np.searchsorted(ends, ends[low] + shape.entries, side="right")) - 1
        high = max(low + 1, min(high, low + shape.docs, len(ids)))
        entries = slice(ends[low], ends[high])
        yield Tree(
            ids[low:high], unnamed[low:high], m[low:high], ends[low : high + 1] - ends[low], ranks[entries], counts[entries], known, shape
        )
        low = high


def search(docs: DataFrame, items: DataFrame, k: int = 20, terms_at_once: int = TERMS, shape: Shape = Shape()) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item_id, rank, doc_id, score.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text; other columns are not
    looked at.  Terms are runs of digits, letters a-z (A-Z count as these) and non-ASCII characters.
    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))) for N documents with terms, df of which have
    it.  A document of n terms, L being those of all, has m = 75 + (25 n N) div L, and scores the
    sum of weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.  Equal
    scores go by doc_id, NULL last.

    Items are the query set, taken in blocks of ``terms_at_once`` different terms at most; their
    terms alone are kept of documents.  Each partition puts these term vectors, most frequent terms
    first, into trees and searches them for one item after the other, the k-th score so far
    carried from tree to tree.  Partitions give k documents an item at most, merged in two steps.

    NULL texts and texts without terms have no score and do not count in N; items without terms
    have no rows.  Every row of ``items`` is ranked by itself, with equal ids too; repeated rows of
    ``docs`` rank side by side.  Without documents or items there are no rows.
    """
    id_type = items.schema["item_id"].dataType
    found = []
    for known, queries in _blocks(items, terms_at_once):
        hits = _searched(cut(restricted(docs, known)), queries, len(known), k, shape)
        if hits is None:
            break
        best = top_per_group(hits, ["number"], [F.desc("score"), F.asc_nulls_last("doc_id")], "doc_id", k, "rank")
        names = docs.sparkSession.createDataFrame(
            [(q.number, q.item_id) for q in queries], T.StructType().add("number", T.LongType()).add("item_id", id_type)
        )
        found.append(cut(best).join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    if not found:
        schema = T.StructType().add("item_id", id_type).add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType())
        return docs.sparkSession.createDataFrame([], schema)
    return union_all(found)
