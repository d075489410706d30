"""Bounded samples of labelled rows, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; NULL counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, most_bytes: int = 64 << 20
) -> list[tuple[bytes, object]]:
    """Up to ``most`` (text, label) rows on the driver, whole texts, in a fixed pseudo-random order.

    Rows are those of ``labels`` (doc_id, label) for which ``usable`` holds and the label is
    not NULL, chosen by a hash of doc_id; a doc_id counts once.  Both bounds are the point: what is
    learned from does not grow with the input, and only ids are ordered.
    """
    chosen = (
        labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"))
        .withColumn("o", F.xxhash64(F.lit("sample"), "doc_id"))
        .orderBy("o")
        .limit(most)
    )
    return fetched(docs, chosen, most_bytes)


def fetched(docs: DataFrame, chosen: DataFrame, most_bytes: int) -> list[tuple[bytes, object]]:
    """(text, y) of the chosen (doc_id, y, o), of which there must be a bounded number, ordered by o.

    Sizes are looked up first; texts that would bring the sum above ``most_bytes`` are passed over
    whole, and the others fetched whole.  Of several rows with a doc_id the least text is taken.
    """
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    sized = (
        texts.select("doc_id", F.octet_length("text").alias("size"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "y", "o")
        .agg(F.max("size").alias("size"))
        .orderBy("o", "doc_id")
        .collect()
    )
    total, kept = 0, []
    for r in sized:
        if total + r["size"] <= most_bytes:
            total += r["size"]
            kept.append((r.doc_id, r.y, r.o))
    if not kept:
        return []
    ids = docs.sparkSession.createDataFrame(kept, chosen.select("doc_id", "y", "o").schema)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "o").agg(F.min("text").alias("text"))
    return [(r.text.encode(), r.y) for r in rows.orderBy("o", "doc_id").collect()]
