"""Phrases whose words keep together, mined by dynamic itemset counting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_shared, shared_table, top_per_group, union_all

#: Signs between pieces, all read as line feeds; capitals of ASCII count as small letters.
_SIGNS = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Language of texts without one.
NO_LANGUAGE = "und"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Settings:
    """Lengths of phrases in words, the count from which a phrase is frequent, and parts of a cycle.

    The filter of frequent phrases has ``cells`` of 64 bits, a power of two: its size is fixed,
    whatever it holds.  A task looks at ``together`` bytes of text at a time (or one text).
    Pairs of words are first counted in at most ``pairs`` cells, a power of two from 8 on.
    """

    longest: int = 5
    least: int = 100
    shards: int = 2
    cells: int = 1 << 18
    together: int = 3 << 20
    pairs: int = 1 << 27


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _ODD[0]
    values = (values ^ (values >> np.uint64(29))) * _ODD[1]
    return values ^ (values >> np.uint64(32))


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its cell of the filter and the two bits it sets there."""
    bits = (np.uint64(1) << ((hashes >> np.uint64(40)) & np.uint64(63))) | (
        np.uint64(1) << ((hashes >> np.uint64(52)) & np.uint64(63))
    )
    return (hashes & np.uint64(cells - 1)).astype(np.int64), bits


def _holds(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell, bits = _cells(hashes, len(filter_))
    return filter_[cell] & bits == bits


class _Words(dict):
    """Words of one language by number; the numbers of a stretch go on from language to language.

    The sign "." is never part of a word here: it stands for any border of pieces and has number 0.
    """

    def __init__(self, names: list[bytes]) -> None:
        super().__init__({b".": 0})
        self._names = names

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self._names)
        self._names.append(word)
        return number


class _Gathered:
    """Texts that become one stretch: its words with their languages, and their order by number."""

    def __init__(self) -> None:
        self.size = 0
        self._names, self._words = [b""], {}
        self._lang_of, self._numbers = [np.zeros(1, np.int32)], []

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self._words:
            self._words[lang] = len(self._words), _Words(self._names)
        place, words = self._words[lang]
        known = len(self._names)
        found = text.translate(_SIGNS).replace(b"\n", b" . ").split()
        self._numbers.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
        self._numbers.append(np.zeros(1, np.uint32))
        self._lang_of.append(np.full(len(self._names) - known, place, np.int32))
        self.size += len(text)

    def row(self) -> list:
        return _row(list(self._words), self._names, np.concatenate(self._lang_of), np.concatenate(self._numbers))


#: A stretch of texts: its languages; its words, of which the first is none, and the language of each;
#: the number of each word in turn, 0 at a border of pieces; and how many words these are.
_STRETCH = [
    ("langs", pa.list_(pa.string())), ("words", pa.binary()), ("lang_of", pa.binary()), ("numbers", pa.binary()), ("n", pa.int64())
]
_STRETCH_DDL = "langs array<string>, words binary, lang_of binary, numbers binary, n long, shard int"


def _width(words: int) -> str:
    """Type of the numbers of so many words."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _row(langs: list[str], names: list[bytes], lang_of: np.ndarray, numbers: np.ndarray) -> list:
    packed = numbers.astype(_width(len(names))).tobytes()
    return [langs, b"\n".join(names), lang_of.astype("<i4").tobytes(), packed, int(np.count_nonzero(numbers))]


def _batch(rows: list[tuple[list, int]]) -> pa.RecordBatch:
    """Stretches with their shards."""
    columns = [pa.array([row[i] for row, _ in rows], kind) for i, (_, kind) in enumerate(_STRETCH)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([shard for _, shard in rows], pa.int32())], names=[*[name for name, _ in _STRETCH], "shard"]
    )


class _Stretch:
    """Words of some texts by number, and the phrases that the filters let in.

    Phrases are told apart by numbers given to words and to beginnings, not by their hashes.
    """

    def __init__(self, langs: list[str], words: bytes, lang_of: bytes, numbers: bytes) -> None:
        import xxhash

        self.langs, self.names = langs, words.split(b"\n")
        self.lang_of = np.frombuffer(lang_of, "<i4")
        self.word = np.frombuffer(numbers, _width(len(self.names))).astype(np.int64)
        of_lang = np.array([xxhash.xxh3_64_intdigest(name.encode(), seed=1) for name in langs], np.uint64)
        of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], np.uint64)
        self.hashes = _mixed(of_word ^ of_lang[self.lang_of])

    def pairs(self) -> np.ndarray:
        """Hashes of all neighbouring words."""
        at = np.flatnonzero((self.word[:-1] > 0) & (self.word[1:] > 0))
        return _mixed(self.hashes[self.word[at]] * _ODD[2] + self.hashes[self.word[at + 1]])

    def phrases(self, now: np.ndarray, possible: np.ndarray, longest: int) -> Iterator[_Phrases]:
        """Words, then the phrases of 2, 3 ... words whose beginning and end the filter holds.

        Pairs whose cell of ``possible`` is not set are left out, and what they are a part of.
        """
        at = np.flatnonzero(self.word)
        number, hashes = self.word[at], self.hashes
        words = (np.arange(len(self.names)),)
        yield _Phrases(1, at, number, words, hashes, np.bincount(number, minlength=len(hashes)), None, None)
        for length in range(2, longest + 1):
            # A phrase begins where its beginning does and where its end begins one word later.
            held = _holds(now, hashes)[number]
            at, number = at[held], number[held]
            number_at = np.full(len(self.word) + 1, -1, np.int64)
            number_at[at] = number
            end = number_at[at + 1]
            good = np.flatnonzero(end >= 0)
            at, number, end = at[good], number[good], end[good]
            last = self.word[at + length - 1]
            if length == 2:
                good = _is_possible(possible, _mixed(hashes[number] * _ODD[2] + self.hashes[last]))
                at, number, end, last = at[good], number[good], end[good], last[good]
            inverse, keys = pd.factorize(number << 32 | last)
            begin, last = keys >> 32, keys & 0xFFFFFFFF
            end_of = np.empty(len(keys), np.int64)
            end_of[inverse] = end
            hashes = _mixed(hashes[begin] * _ODD[2] + self.hashes[last])
            words = (*[w[begin] for w in words], last)
            number = inverse
            yield _Phrases(length, at, number, words, hashes, np.bincount(number, minlength=len(keys)), begin, end_of)


@dataclass(frozen=True)
class _Phrases:
    """Phrases of one length: where they begin and which they are; of each its words, its hash and count,
    and the shorter phrases that are its beginning and its end."""

    length: int
    at: np.ndarray
    number: np.ndarray
    words: tuple[np.ndarray, ...]
    hashes: np.ndarray
    counts: np.ndarray
    begin: np.ndarray | None
    end: np.ndarray | None


def counted(
    stretch: _Stretch, now: np.ndarray, cycle_ago: np.ndarray | None, possible: np.ndarray, longest: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the active phrases in some texts: lang, words (their number), phrase, hash, c.

    Words are active in the first cycle, that is without ``cycle_ago``.  A longer phrase is active if
    the filter ``now`` holds both its beginning and its end, the phrases shorter by one word, and
    ``cycle_ago`` did not let it in already: then it has been counted in a whole cycle.
    """
    names, langs = pa.array(stretch.names, pa.binary()), pa.array(stretch.langs, pa.string())
    before, shorter = np.empty(0, bool), np.empty(0, np.uint64)
    for p in stretch.phrases(now, possible, longest):
        # Whether a phrase was active one cycle ago; if there is one, all words were.
        if p.begin is None:
            before = np.full(len(p.hashes), cycle_ago is not None)
        elif cycle_ago is not None:
            before = before & _holds(cycle_ago, shorter)
            before = before[p.begin] & before[p.end]
        else:
            before = np.zeros(len(p.hashes), bool)
        shorter = p.hashes
        which = np.flatnonzero(~before & (p.counts > 0))
        if len(which):
            words = [w[which] for w in p.words]
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(w)) for w in words], b" ")
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(stretch.lang_of[words[0]])),
                    pa.array(np.full(len(which), p.length, np.int32)),
                    phrase.cast(pa.string()),
                    pa.array(p.hashes[which].view(np.int64)),
                    pa.array(p.counts[which].astype(np.int64)),
                ],
                names=["lang", "words", "phrase", "hash", "c"],
            )
        if not len(p.at):
            break


def shortened(stretch: _Stretch, now: np.ndarray, possible: np.ndarray, length: int) -> list | None:
    """The stretch without words that lie in no phrase of ``length`` words that the filter holds.

    Words left next to each other are a piece; pieces of ``length`` words or fewer are left out.
    """
    steps = np.zeros(len(stretch.word) + 1, np.int64)
    for p in stretch.phrases(now, possible, length):
        if p.length == length:
            held = p.at[_holds(now, p.hashes)[p.number]]
            steps[held] += 1
            steps -= np.bincount(held + length, minlength=len(steps))
    covered = np.cumsum(steps) > 0  # False at its end
    edges = np.flatnonzero(np.diff(covered, prepend=False))
    long_enough = edges[1::2] - edges[::2] > length
    begins, ends = edges[::2][long_enough], edges[1::2][long_enough]
    if not len(begins):
        return None
    # What follows a piece stands for the border behind it.
    inside = np.zeros(len(covered), np.int64)
    inside[begins] = 1
    inside[ends] = -1
    kept = np.cumsum(inside) > 0
    numbers = np.where(kept[:-1], stretch.word, 0)
    kept[ends] = True
    used, numbers = np.unique(np.append(numbers[kept[:-1]], 0), return_inverse=True)
    return _row(stretch.langs, [stretch.names[i] for i in used.tolist()], stretch.lang_of[used], numbers)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Stretch, int]]:
    """Stretches with their shards."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield _Stretch(row["langs"], row["words"], row["lang_of"], row["numbers"]), row["shard"]


def _numbered(docs: DataFrame, settings: Settings) -> DataFrame:
    """Texts (lang, text, shard) as stretches, about ``settings.together`` bytes of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, _Gathered] = {}
        for batch in batches:
            column = batch.column("text")
            encoded = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            rows = zip(batch.column("lang").to_pylist(), encoded, batch.column("shard").to_pylist(), strict=True)
            for lang, text, shard in rows:
                of_shard = gathered.setdefault(shard, _Gathered())
                of_shard.add(lang, text.as_py())
                if of_shard.size > settings.together:
                    yield _batch([(gathered.pop(shard).row(), shard)])
        for shard, of_shard in gathered.items():
            yield _batch([(of_shard.row(), shard)])

    return docs.select("lang", "text", "shard").mapInArrow(run, _STRETCH_DDL)


def _is_possible(possible: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the cells of these pairs are set; there are eight cells a byte, and a power of two of them."""
    cell = (hashes & np.uint64(8 * len(possible) - 1)).astype(np.int64)
    return (possible[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _possible_pairs(shards: DataFrame, settings: Settings) -> np.ndarray:
    """A cell for each hash of a pair: set if all pairs of the cell together are frequent.

    Pairs are counted by cell, not one by one; a pair whose cell is not set cannot be frequent.
    The cells grow with the words, up to ``settings.pairs``, so that few pairs share one.
    """
    words = shards.agg(F.sum("n")).first()[0] or 0
    cells = min(1 << 16, settings.pairs)
    while cells < words // 16 and cells < settings.pairs:
        cells *= 2
    block, least = min(1 << 16, cells), settings.least

    def rows(hashes: list[np.ndarray]) -> pa.RecordBatch:
        cell, counts = np.unique((np.concatenate(hashes) & np.uint64(cells - 1)).astype(np.uint32), return_counts=True)
        of_block = cell // block
        edges = np.flatnonzero(np.diff(of_block, prepend=-1, append=-1))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        places, counts = (cell % block).astype("<u2"), counts.astype("<u4")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(of_block[edges[:-1]].astype(np.int32)),
                pa.array([places[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["block", "places", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        for stretch, _ in _read(batches):
            hashes.append(stretch.pairs())
            if sum(map(len, hashes)) > 1 << 22:
                yield rows(hashes)
                hashes = []
        if sum(map(len, hashes)):
            yield rows(hashes)

    def add(of_block: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for places, counts in zip(of_block["places"], of_block["counts"], strict=True):
            total[np.frombuffer(places.as_py(), "<u2")] += np.frombuffer(counts.as_py(), "<u4")
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"block": of_block["block"].slice(0, 1), "bits": pa.array([bits], pa.binary())})

    found = shards.mapInArrow(run, "block int, places binary, counts binary")
    got = found.groupBy("block").applyInArrow(add, "block int, bits binary").toPandas()
    possible = np.zeros((cells // block, block // 8), np.uint8)
    for number, bits in zip(got["block"], got["bits"], strict=True):
        possible[number] = np.frombuffer(bits, np.uint8)
    return possible.reshape(-1)


def _scan(
    shard: DataFrame, now: np.ndarray, cycle_ago: np.ndarray | None, possible: Broadcast, settings: Settings
) -> DataFrame:
    """Counts of the active phrases in a shard, stretch by stretch."""
    sent = shard.sparkSession.sparkContext.broadcast((now, cycle_ago))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, _ in _read(batches):
            yield from counted(stretch, *sent.value, possible.value, settings.longest)

    return shard.mapInArrow(run, "lang string, words int, phrase string, hash long, c long")


def _shorten(shards: DataFrame, now: np.ndarray, possible: Broadcast, length: int) -> DataFrame:
    """The shards with what later cycles can still need: runs of frequent phrases of ``length`` words."""
    sent = shards.sparkSession.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, shard in _read(batches):
            left = shortened(stretch, sent.value, possible.value, length)
            if left is not None:
                yield _batch([(left, shard)])

    return shards.mapInArrow(run, _STRETCH_DDL)


def _with_frequent(filter_: np.ndarray, found: DataFrame) -> tuple[np.ndarray, bool]:
    """The filter with these phrases added, and whether any of them was missing.

    Cells are put together by Spark; as many rows as the filter has cells come back at most.
    """
    hash_ = F.col("hash")
    one = F.lit(1).cast("long")

    def bit(by: int) -> Column:
        place = F.shiftrightunsigned(hash_, by).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", one, place)

    cells = found.groupBy(hash_.bitwiseAND(F.lit(len(filter_) - 1).cast("long")).alias("cell")).agg(
        F.bit_or(bit(40).bitwiseOR(bit(52))).alias("bits")
    )
    got = cells.toPandas()
    new = filter_.copy()
    new[got["cell"].to_numpy()] |= got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return new, bool((new != filter_).any())


def frequent_phrases(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Phrases of each language that occur ``settings.least`` times or more: lang, words, phrase, f.

    The occurrences of all rarer words of a language together are a row of 0 words.

    The documents are dealt into shards that are read in a cycle.  From the first shard on all words
    are counted.  After each shard, phrases that have reached the threshold so far join the filter of
    frequent ones, and phrases whose beginning and end are both in it are counted from the next shard
    on, until they have seen every shard once.  The cycle ends when nothing is left to count.  The
    filter is a Bloom filter of a fixed size: what it takes wrongly for frequent makes more phrases be
    counted, but no count wrong.  What is active in a shard follows from the filters after the shard
    before and one cycle ago alone, so each phrase is counted once in each shard.

    Texts are put into numbers once, and all passes read the numbers.  Before the first shard, pairs of
    neighbouring words are counted by the cell of their hash, and pairs in cells that stay below the
    threshold are never let in: most pairs of frequent words are rare, and so need no count of their own.

    After n whole cycles all phrases of n words are counted.  From the second on, words that lie in
    no frequent one of them are then left out of the shards, as no longer candidate can hold them.

    Shards and counts are tables in the shared folder; those that are no longer needed are removed.
    """
    spark = docs.sparkSession
    folder = f"phrases-{uuid.uuid4().hex}"
    lang = F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE))
    salted = [c for c in ("doc_id", "text") if c in docs.columns]
    shards = shared_table(
        _numbered(
            docs.filter("text IS NOT NULL").select(
                lang.alias("lang"), "text", F.pmod(F.xxhash64(*salted), F.lit(settings.shards)).cast("int").alias("shard")
            ),
            settings,
        ),
        f"{folder}/shards0",
        by="shard",
    )
    possible = spark.sparkContext.broadcast(_possible_pairs(shards, settings))
    filters: list[np.ndarray | None] = [np.zeros(settings.cells, np.uint64)]
    totals: DataFrame | None = None
    finished: list[DataFrame] = []

    def finish(rows: DataFrame, step: int) -> None:
        """Keep what is complete: frequent phrases, and the sum of rare words."""
        kept = F.col("c") >= settings.least
        closed = (
            rows.filter(kept | (F.col("words") == 1))
            .groupBy("lang", F.when(kept, F.col("words")).otherwise(0).alias("words"), F.when(kept, F.col("phrase")).otherwise("").alias("phrase"))
            .agg(F.sum("c").alias("f"))
        )
        finished.append(shared_table(closed, f"{folder}/closed{step}"))

    step = unchanged = 0
    while step < settings.shards or unchanged < settings.shards:
        cycle = step // settings.shards
        if cycle > 1 and step % settings.shards == 0:
            shards = shared_table(_shorten(shards, filters[step], possible, cycle), f"{folder}/shards{cycle}", by="shard")
            drop_shared(spark, f"{folder}/shards{cycle - 1 if cycle > 2 else 0}")
        cycle_ago = filters[step - settings.shards] if step >= settings.shards else None
        shard = shards.filter(F.col("shard") == step % settings.shards)
        found = _scan(shard, filters[step], cycle_ago, possible, settings).withColumn("since", F.lit(step))
        if totals is not None:
            # A phrase was let in when it was first seen or before, so a cycle later it is complete.
            complete = F.col("since") <= step - settings.shards
            if step >= settings.shards:
                finish(totals.filter(complete), step)
            found = totals.filter(~complete).unionByName(found)
        # One phrase has one hash, so taking the largest takes the only one.
        totals = shared_table(
            found.groupBy("lang", "words", "phrase").agg(
                F.max("hash").alias("hash"), F.sum("c").alias("c"), F.min("since").alias("since")
            ),
            f"{folder}/step{step}",
        )
        drop_shared(spark, f"{folder}/step{step - 1}")
        reached = totals.filter((F.col("c") >= settings.least) & (F.col("words") < settings.longest))
        following, grown = _with_frequent(filters[step], reached)
        filters.append(following)
        if step >= settings.shards:
            filters[step - settings.shards] = None
        unchanged = 0 if grown else unchanged + 1
        step += 1
    finish(totals, step)
    for name in (f"shards{cycle if cycle > 1 else 0}", f"step{step - 1}"):
        drop_shared(spark, f"{folder}/{name}")
    return union_all(finished).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, settings: Settings = Settings(), k: int = 2000, inside_percent: int = 100) -> DataFrame:
    """Each language's ``k`` phrases whose words keep together most: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text (doc_id, if there, only deals rows to shards); other columns are not
    looked at.  Texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs
    into words; A-Z count as small letters.  A candidate is a phrase of 2 to ``settings.longest`` words
    that occurs a >= ``settings.least`` times in a language, overlaps included.  Cut after its first
    words, with l and r occurrences of the two parts among n words of the language, it scores
    floor(1000 a n / (l r)); the cut with the lowest score counts, of equal ones the first.
    Candidates inside a longer one that occurs at least ``inside_percent`` % as often are left out.
    Equal scores go by a, then by the phrase's bytes.

    NULL lang is ``und``; NULL and empty texts and empty tables have no words and give no rows; texts
    of any length and repeated rows are counted whole.
    """
    frequent = frequent_phrases(docs, settings)
    frequent = shared_table(frequent, f"phrases-{uuid.uuid4().hex}/frequent")
    sizes = frequent.filter("words <= 1").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = frequent.filter("words > 0").select("lang", "phrase", "f")
    candidates = frequent.filter("words > 1").select("lang", "phrase", "words", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))

    def stretch(begin: Column | int, length: Column) -> Column:
        return F.array_join(F.slice("w", begin, length), " ")

    cut_after = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", stretch(1, F.col("k")).alias("first"), stretch(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    whole = "decimal(19,0)"
    score = F.call_function(
        "div",
        (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)")),
        F.col("l").cast(whole) * F.col("r").cast("decimal(18,0)"),
    )
    scored = (
        cut_after.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(sizes, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s"))
        .select("lang", "phrase", "s.*")
    )
    inner = candidates.filter("words > 2").select(
        "lang",
        "a",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.col("words") - 1),
                    lambda b: F.transform(
                        F.sequence(F.lit(2), F.least(F.col("words") - 1, F.col("words") - b + 1)),
                        lambda n: F.array_join(F.slice("w", b, n), " "),
                    ),
                )
            )
        ).alias("phrase"),
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return top_per_group(kept, ["lang"], order, "phrase", k, "rank").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
