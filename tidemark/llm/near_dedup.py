"""Near-duplicate documents by bottom-k sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, components, cut, union_all

#: Odd factors of the words of a shingle.  Fixed, so that sketches of different runs compare.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WORDS_KEPT = 500_000


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    A-Z count as a-z, words stand between blanks, and a text of fewer than ``width`` words is one
    shingle.  NULL and blank texts have none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    sums = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        sums += codes[i : len(words) - take + 1 + i] * np.uint64(FACTORS[i % len(FACTORS)] + 2 * (i // len(FACTORS)))
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0x7FB5D329728EA185)
    sums ^= sums >> np.uint64(27)
    return np.unique(sums.view(np.int64))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Per row: doc_id, size of its shingle set, fingerprint of the set, its k smallest hashes."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, width, hashes) for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "print": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [s[:k] for s in sets],
            }

    return arrow_rows(
        docs.select(F.col("doc_id").cast("long"), "text"),
        each,
        "doc_id long, n_shingles long, print binary, sketch array<long>",
    )


def pools(reps: DataFrame, fewest: int, percent: int) -> DataFrame:
    """Pools (hub, rep) of sets such that any two linked sets meet in a pool.

    Sets with a similarity of ``percent`` or more share at least ``fewest`` of their retained
    values (or ``percent`` of all, where a set is smaller).  So, with the values of each set in one
    order, here from rare to frequent, they also share one of the first ``size - fewest + 1``;
    values that many documents hold are left over only where nearly all of a document's values are
    such.  Of the inverted lists of these values, those with the same smallest member are one pool.
    """
    values = reps.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    overlap = F.least(F.lit(fewest), F.ceil(F.col("n") * percent / 100))
    lists = cut(
        values.join(shared, "v")
        .groupBy("rep")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
        .withColumn("take", (F.size("shared") - overlap + 1).cast("int"))
        .filter("take > 0")
        .select("rep", F.explode(F.slice("shared", 1, F.col("take"))).alias("at"))
        .select("rep", "at.v")
    )
    hubs = lists.groupBy("v").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    return lists.join(hubs, "v").select("hub", "rep").distinct()


def blocks(members: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Rows of each pool once for every pair of blocks (i, j) to compare, i not over j.

    A pool of up to ``most`` members and ``most_bytes`` of text is one block.  A larger one is
    dealt into blocks, and each row goes to every pair its block is in, so that no task holds more
    than two blocks and the pairs of a pool are never written out.
    """
    sizes = members.groupBy("hub").agg(F.count("*").alias("members"), F.sum(F.octet_length("text")).alias("bytes"))
    number = F.ceil(F.greatest(F.col("members") / most, F.col("bytes") / most_bytes)).cast("int")
    own = F.when(F.col("n_blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")).otherwise(0)
    return (
        members.join(sizes.select("hub", F.greatest(number, F.lit(1)).alias("n_blocks")), "hub")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "text")
    )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the given sets, by products of 0/1 matrices of bounded width."""
    counts = np.zeros((len(sets), len(sets)), np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        counts += matrix @ matrix.T
    return counts.astype(np.int64)


def estimates(retained: list[np.ndarray], a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Of the k smallest values of two united sketches, the share that both hold; for pairs (a, b)."""
    none = np.iinfo(np.int64).max
    padded = np.full((len(retained), k), none, np.int64)
    for row, values in zip(padded, retained, strict=True):
        row[: len(values)] = values
    out = np.empty(len(a))
    for low in range(0, len(a), 20_000):
        part = slice(low, low + 20_000)
        both = np.sort(np.concatenate([padded[a[part]], padded[b[part]]], axis=1), axis=1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
        rank = np.cumsum(~again & (both != none), axis=1)
        out[part] = (again & (rank <= k)).sum(axis=1) / np.minimum(rank[:, -1], k)
    return out


def block_links(
    ids: list[int], own: list[int], sets: list[np.ndarray], k: int, fewest: int, percent: int, margin: float
) -> list[tuple[int, int]]:
    """Links among the sets of one pair of blocks: enough of them to connect what is linked.

    Retained values first give overlaps, then the united sketches an estimate; whole sets decide.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    blocks_of = np.array(own)
    retained = [s[:k] for s in sets]
    least = np.minimum(fewest, -(-percent * sizes // 100))
    found = overlaps(retained) >= np.minimum(least[:, None], least[None, :])
    found &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    if blocks_of.min() != blocks_of.max():
        found &= blocks_of[:, None] != blocks_of[None, :]
    a, b = np.nonzero(np.triu(found, 1))
    if not len(a):
        return []
    likely = estimates(retained, a, b, k) >= percent / 100 - margin
    a, b = a[likely], b[likely]
    if len(a) > 4 * n:
        used = np.unique(np.concatenate([a, b]))
        place = np.zeros(n, np.int64)
        place[used] = np.arange(len(used))
        both = overlaps([sets[i] for i in used])[place[a], place[b]]
    else:
        both = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(a, b, strict=True)])
    linked = 100 * both >= percent * (sizes[a] + sizes[b] - both) if len(a) else np.zeros(0, bool)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        if (x := root(i)) != (y := root(j)):
            parent[y] = x
            links.append((ids[i], ids[j]))
    return links


def compared(rows: DataFrame, width: int, k: int, fewest: int, percent: int, margin: float) -> DataFrame:
    """Links (a, b) found in all pairs of blocks; a task holds one pair of blocks at a time."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        at, ids, own, sets = None, [], [], []

        def links() -> dict:
            pairs = block_links(ids, own, sets, k, fewest, percent, margin) if len(ids) > 1 else []
            return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

        for batch in batches:
            for hub, i, j, block, rep, text in zip(
                *(batch[c] for c in ("hub", "i", "j", "own", "rep", "text")), strict=True
            ):
                if (hub, i, j) != at:
                    yield links()
                    at, ids, own, sets = (hub, i, j), [], [], []
                ids.append(rep)
                own.append(block)
                sets.append(shingle_set(text, width, hashes))
        yield links()

    dealt = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return arrow_rows(dealt, each, "a long, b long").filter("a != b").distinct()


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    k: int = 48,
    fewest: int = 20,
    margin: float = 0.3,
    block: int = 256,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents (columns doc_id, text; others are not read) are linked if the sets of their shingles
    of ``width`` words have a Jaccard similarity of ``percent`` or more.  component_id is the
    smallest doc_id that links reach; kept says that it is the document's own.

    * Links are confirmed on whole sets.  A pair at the threshold shares fewer than 20 of 48
      retained values with a probability of about 1e-9, and farther above it less.
    * Equal sets stand for one another, whatever their number.
    * NULL, empty and blank texts have 0 shingles and no link: they are kept, each for itself.
    * Rows with the same doc_id are one document: what one of them is linked with, all are.
    * Rows without doc_id have no component (NULL) and are kept.
    * Tables without rows give no rows.
    """
    rows = cut(sketches(docs, width, k))
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(
        named.groupBy("print").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
        )
    )
    met = cut(pools(reps, fewest, percent))
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
        .join(met.select("rep").distinct(), "rep", "left_semi")
    )
    found = compared(blocks(met.join(texts, "rep"), block, block_bytes), width, k, fewest, percent, margin)
    several = named.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("x != y")
    same_id = (
        named.join(several.select("doc_id"), "doc_id", "left_semi")
        .join(reps.select("print", "rep"), "print")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    linked = components(union_all([found, same_id]))
    return (
        rows.select("doc_id", "n_shingles", "print")
        .join(reps.select("print", "rep"), "print", "left")
        .withColumn("rep", F.coalesce("rep", "doc_id"))
        .join(linked.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each group of near copies stays.

    Of several rows with one doc_id one stays, that with the smallest text; rows without doc_id
    stay.  ``settings`` are those of ``near_duplicates``.
    """
    found = near_duplicates(docs, **settings).filter("kept AND doc_id IS NOT NULL")
    ids = cut(found.groupBy("doc_id").agg(F.count("*").alias("__rows")))
    single = docs.join(ids.filter("__rows = 1").select("doc_id"), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy("text")
    several = (
        docs.join(ids.filter("__rows > 1").select("doc_id"), "doc_id", "left_semi")
        .withColumn("__row", F.row_number().over(first))
        .filter("__row = 1")
        .drop("__row")
    )
    return union_all([single, several, docs.filter("doc_id IS NULL")]).select(docs.columns)
