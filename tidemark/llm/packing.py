"""Documents packed into sequences of one length, neighbours on a space-filling curve together."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, cut

#: Buckets of a document's hashed vector, a power of two.
BUCKETS = 4096
#: Projected values are kept as whole multiples of this, so that their sums do not depend on their order.
UNIT = 2.0**-20
#: Words, and runs of signs within them, whose ids a worker remembers at most.
REMEMBERED = 600_000
#: Bytes of text whose words are looked up together.
TOGETHER = 8 << 20
#: Words of signs whose treatment by the tokenizer is plain: ASCII and the letters and marks of western Europe.
#: Apostrophes and the signs of special tokens can make pieces belong together.
_PLAIN, _JOINING = "^[!-~À-ÖØ-öø-ÿŒœ¡¿«»–—‘’“”„…]+$", r"'|<\|"
#: Their pieces in lower case, which the tokenizer treats one by one.
_RUNS = "([a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9]+)"


def _byte_signs() -> str:
    """Byte-level vocabularies write a byte without a visible Latin-1 sign as the next sign from 256 on.

    All bytes are listed, as looking up one that is not costs far more.
    """
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    signs = {b: 256 + i for i, b in enumerate(hidden)}
    return "".join(chr(signs.get(b, b)) for b in range(256))


def _bytes(values: pa.Array) -> list[bytes]:
    """Strings as UTF-8, cut out of their buffer."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8).tolist()
    data = values.buffers()[2].to_pybytes() if ends[-1] else b""
    return [data[a:b] for a, b in itertools.pairwise(ends)]


def _side_by_side(
    ids: list[bytes], which: pa.Array, lists: pa.Array, dtype: np.dtype
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts of all lists one after the other, and where those of each list end.

    ``which`` says for each part whose ``ids`` it has.
    """
    known, places = np.frombuffer(b"".join(ids), dtype), which.to_numpy(zero_copy_only=False)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
    taken = lengths[places]
    ends = np.concatenate(([0], np.cumsum(taken)))
    shift = (np.cumsum(lengths) - lengths)[places] - ends[:-1]
    parts_until = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return known[np.arange(ends[-1]) + np.repeat(shift, taken)], ends[parts_until]


class WordIds(dict):
    """Token ids of a word as bytes (unsigned, little-endian), asked of the tokenizer once.

    For the tokenizer whose words end at white space: the ids of a text are those of its words one
    after the other.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self._code = "I" if wide else "H"
        self._model = self.tokenizer.model
        self._signs = _byte_signs()
        self._runs: dict[bytes, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        # For a few numbers this takes a fraction of the time of an array of numpy.
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _run(self, run: bytes) -> bytes:
        found = self._runs.get(run)
        if found is None:
            text = run.decode() if run.isascii() else run.decode("latin-1").translate(self._signs)
            found = self._packed([t.id for t in self._model.tokenize(text)])
            if len(self._runs) > REMEMBERED:
                self._runs.clear()
            self._runs[run] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        found = self._packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, words: pa.Array) -> list[bytes]:
        """Ids of different words, new ones among them together.

        Plain words are cut into runs, which recur more often than words, and only merged; all
        others are asked for whole.
        """
        names = _bytes(words)
        if len(self) + len(names) > REMEMBERED:
            self.clear()
        new = words.filter(pa.array([name not in self for name in names], pa.bool_()))
        plain = pc.and_not(pc.match_substring_regex(new, _PLAIN), pc.match_substring_regex(new, _JOINING))
        new = new.filter(plain)
        # Plain words hold no blank, so blanks tell their runs apart.
        runs = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(new), _RUNS, r"\1 "))
        different = runs.flatten().dictionary_encode()
        of_run = list(map(self._run, _bytes(different.dictionary)))
        ids, ends = _side_by_side(of_run, different.indices, runs, self.dtype)
        data, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        self.update(zip(_bytes(new), [data[a:b] for a, b in itertools.pairwise([0, *ends])], strict=True))
        return list(map(self.__getitem__, names))


@lru_cache(maxsize=1)
def word_ids(definition: str) -> WordIds:
    """The ids that a worker remembers from one task to the next."""
    return WordIds(definition)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates, each below ``2 ** bits``.

    The coordinates' bits are read from the highest on.  In each step the part of the cube that a
    point lies in fixes how the curve is turned in there: lower bits of the first axis are
    inverted, or exchanged with those of the axis.  The parts are numbered in Gray code.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(axes)):
            inside = (axes[i] >> level) & 1 == 1
            swap = np.where(inside, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(inside, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def _directions(dims: int) -> np.ndarray:
    """Fixed random directions in the space of hashed vectors."""
    return np.random.default_rng(11).standard_normal((BUCKETS, dims))


def _bucket(ids: np.ndarray) -> np.ndarray:
    """The bucket of the hashed vector that each id counts in."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)
    return (hashed % np.uint32(BUCKETS)).astype(np.int64)


def _projected(buckets: np.ndarray, directions: np.ndarray) -> list[int]:
    """A document's hashed vector of damped id counts, of length 1, on each direction."""
    counts = np.bincount(buckets)
    used = np.flatnonzero(counts)
    weights = np.log1p(counts[used])
    values = weights @ directions[used] / np.sqrt(weights @ weights)
    return np.rint(values / UNIT).astype(np.int64).tolist()


def _stretches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts about ``TOGETHER`` bytes at a time (or one text), with the place of the first."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        so_far = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, so_far + TOGETHER, side="right")), start + 1)
        yield start, texts.slice(start, stop - start)
        start = stop


def _ids_of(texts: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's ids end.

    Each different word is looked up once; its ids are then taken for all its places.
    """
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    return _side_by_side(ids.of(words.dictionary), words.indices, split, ids.dtype)


def _tokenized(docs: DataFrame, definition: str, end: int, dims: int) -> DataFrame:
    """Per document: doc_id, its ids with the end as bytes, their number, and its projected vector."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    types = T.StructType.fromDDL(f"doc_id {id_type}, ids binary, tokens long, point array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ids, schema = word_ids(shared.value), to_arrow_schema(types)
        last = np.array([end], ids.dtype)
        size = ids.tokenizer.get_vocab_size(with_added_tokens=True)
        bucket = _bucket(np.arange(max(size, end + 1), dtype=np.uint32))
        directions = _directions(dims)
        for batch in batches:
            for start, texts in _stretches(pc.fill_null(batch.column("text"), "")):
                flat, ends = _ids_of(texts, ids)
                rows = [np.concatenate((flat[a:b], last)) for a, b in itertools.pairwise([0, *ends.tolist()])]
                columns = [
                    batch.column("doc_id").slice(start, len(texts)).cast(schema.field("doc_id").type),
                    pa.array([row.tobytes() for row in rows], schema.field("ids").type),
                    pa.array(list(map(len, rows)), schema.field("tokens").type),
                    pa.array([_projected(bucket[row], directions) for row in rows], schema.field("point").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, types)


def _placed(tokenized: DataFrame, dims: int, bits: int) -> DataFrame:
    """The rows with ``key``, their place on the curve through the cells of their points.

    Each axis is cut into cells about the mean of all documents, 3 deviations to either side.
    """
    axes = [F.col("point")[i] for i in range(dims)]
    sums = tokenized.agg(
        F.count("*").alias("n"),
        *[F.sum(a).alias(f"s{i}") for i, a in enumerate(axes)],
        *[F.sum(a.cast("decimal(19,0)") * a).alias(f"q{i}") for i, a in enumerate(axes)],
    ).first()
    n = max(sums["n"], 1)
    mean = [(sums[f"s{i}"] or 0) / n for i in range(dims)]
    deviation = [max(float(sums[f"q{i}"] or 0) / n - m * m, 1.0) ** 0.5 for i, m in enumerate(mean)]
    side = 1 << bits

    @F.pandas_udf("long")
    def key(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype="int64")
        cells = (np.stack(points.to_numpy()) - mean) / deviation * (side / 6) + side / 2
        return pd.Series(hilbert(np.clip(np.floor(cells), 0, side - 1), bits))

    return tokenized.withColumn("key", key("point")).drop("point")


def _cut_up(ordered: DataFrame, dtype: str, length: int) -> DataFrame:
    """Lay the rows of each partition end to end from its ``base`` on and cut at whole sequences."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        at: int | None = None
        for batch in batches:
            out: dict[str, list] = {
                c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "key")
            }
            for doc_id, data, base, key in zip(batch["doc_id"], batch["ids"], batch["base"], batch["key"], strict=True):
                at = base if at is None else at
                ids = np.frombuffer(data, dtype).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at, length)
                    taken = min(len(ids) - start, length - offset)
                    piece = ids[start : start + taken].tobytes()
                    row = (doc_id, start, taken, piece, len(ids), sequence, offset, key)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    start, at = start + taken, at + taken
            yield out

    id_type = ordered.schema["doc_id"].dataType.simpleString()
    return arrow_rows(
        ordered.select("doc_id", "ids", "base", "key"),
        each,
        f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, key long",
    )


def pack(
    docs: DataFrame, vocabulary: str, length: int = 2048, end: int = 1, dims: int = 4, bits: int = 12
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: one row per piece.

    ``docs`` has doc_id and text; further columns are not looked at.  ``vocabulary`` is the path of
    a tokenizer file (library ``tokenizers``) whose words end at white space; it is read once and
    sent along.  A document is its ids and the id ``end``.  Rows hold doc_id, start and length of
    the piece within its document, ids (unsigned 32-bit, little-endian), doc_tokens of the whole
    document, sequence_id and offset of the piece, and the document's key on the curve.

    Documents are laid end to end in the order of a Hilbert curve through ``dims`` random projections
    of their hashed vectors, cut into ``2 ** bits`` cells an axis, so like texts share a sequence.
    Every sequence but the last is full, and only the last needs padding.

    NULL texts are empty and, like all empty texts, hold the end alone.  Long texts take as many
    sequences as they need.  Documents with one key come by doc_id (NULL first), repeated rows side
    by side; each row is packed.  A table without rows gives none.  Ranges of the curve are sorted
    in tasks of their own and only the token count of each range is summed up.
    """
    definition = Path(vocabulary).read_text(encoding="utf-8")
    dtype = word_ids(definition).dtype.str
    tokenized = cut(_tokenized(docs, definition, end, dims))
    # Equal rows differ by their place in the table alone, so ranges can split any number of them.
    order = ["key", "doc_id", "__hash", "__row"]
    placed = _placed(tokenized, dims, bits).withColumns(
        {"__hash": F.xxhash64("ids"), "__row": F.monotonically_increasing_id()}
    )
    ordered = cut(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "ids", "tokens", "key", F.spark_partition_id().alias("part"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ordered.groupBy("part")
        .agg(F.sum("tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    # One row for each range: as many as there are partitions.
    return _cut_up(ordered.join(F.broadcast(bases), "part"), dtype, length)
