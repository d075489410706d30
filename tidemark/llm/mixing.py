"""Mixing sources to target weights along a curriculum that changes over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, numbered, running_total, word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: How a source's weight runs over training, as factors at the start, middle and end; repeating.
#: The mean of each over time is 1, so that the integral of a schedule is the source's weight.
RAMPS = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def schedules(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[tuple[float, ...], ...] = RAMPS) -> DataFrame:
    """Add ``weight`` and ``knots`` to sources numbered by ``rank`` from 0.

    knots is an array of (t, w): the weight runs straight from knot to knot, with t from 0 to 1.
    """
    pick = lambda values, rank: F.get(F.array(*values), F.pmod(rank, F.lit(len(values))).cast("int"))
    rank = F.col("rank")
    curve = lambda ramp: F.array(
        *[F.struct(F.lit(i / (len(ramp) - 1)).alias("t"), F.lit(float(w)).alias("w")) for i, w in enumerate(ramp)]
    )
    return sources.withColumn("weight", pick([F.lit(w) for w in weights], rank)).withColumn(
        "knots",
        F.transform(pick([curve(r) for r in ramps], rank), lambda k: F.struct(k["t"].alias("t"), (k["w"] * F.col("weight")).alias("w"))),
    )


def segments(knots: Column) -> Column:
    """Pieces of a schedule with the share of its whole integral before each (from) and up to its end (to)."""
    piece = F.transform(
        F.slice(knots, 1, F.greatest(F.size(knots) - 1, F.lit(1))),
        lambda k, i: F.struct(
            k["t"].alias("t0"),
            (F.get(knots, i + 1)["t"] - k["t"]).alias("length"),
            k["w"].alias("w0"),
            F.get(knots, i + 1)["w"].alias("w1"),
        ),
    )
    area = lambda p: (p["w0"] + p["w1"]) / 2 * p["length"]
    whole = F.aggregate(piece, F.lit(0.0), lambda total, p: total + area(p))
    return F.transform(
        piece,
        lambda p, i: F.struct(
            *[p[f].alias(f) for f in ("t0", "length", "w0", "w1")],
            F.try_divide(F.aggregate(F.slice(piece, 1, i), F.lit(0.0), lambda total, q: total + area(q)), whole).alias("from"),
            F.try_divide(F.aggregate(F.slice(piece, 1, i + 1), F.lit(0.0), lambda total, q: total + area(q)), whole).alias("to"),
        ),
    )


def position(share: Column, pieces: Column) -> Column:
    """Training position from 0 to 1 at which a share of a source's demand has been met.

    Inverts the integral of the piece of the schedule that the share falls into, which is a
    quadratic function of time.
    """
    piece = F.element_at(F.concat(F.filter(pieces, lambda p: share < p["to"]), F.slice(pieces, -1, 1)), 1)
    part = lambda p: F.coalesce(F.try_divide(share - p["from"], p["to"] - p["from"]), F.lit(0.0))
    # share of the piece's area -> share of its length, in a form that holds for flat pieces
    root = lambda p: F.sqrt(
        F.greatest(p["w0"] * p["w0"] + (p["w1"] * p["w1"] - p["w0"] * p["w0"]) * part(p), F.lit(0.0))
    )
    along = lambda p: F.coalesce(F.try_divide(part(p) * (p["w0"] + p["w1"]), p["w0"] + root(p)), F.lit(0.0))
    found = F.transform(F.array(piece), lambda p: p["t0"] + p["length"] * along(p))
    return F.element_at(found, 1)


def targets(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target``: the total of all sizes shared by weight, no source above ``most`` times its own.

    What is above is shared anew among the others, until none is above.  A round is one sum over
    the sources.
    """
    size, weight, cap = F.col("source_size"), F.col("weight"), most * F.col("source_size")
    total, level = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while True:
        over = cap < F.lit(level) * weight
        capped, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0))
        ).first()
        following = (total - capped) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * weight))


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken and positions.

    Columns doc_id, source and text are read.  size counts words between blanks.  Sources, ordered
    by name with NULL last, weigh 1, 2, 3, repeating (``schedules``), and share the sum of all
    sizes; none gets more than ``most`` times its own size.  A source's documents form one stream,
    in the order of a digest of doc_id and then of size, passed through again where the target is
    larger.  positions holds the training position (0 to 1) of each pass in which the document is
    taken, that is in which its middle comes before the target; taken is size times their number.

    Results depend on the rows alone, so reruns agree.  NULL and empty texts have size 0 and are
    never taken; documents of equal doc_id and size are alike; tables without rows give none.
    """
    stream = cut(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest")
        )
    )
    totals = stream.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "rank")
    sources = targets(cut(schedules(ranked)), most).withColumn("pieces", segments(F.col("knots")))
    rows = sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    keyed = stream.join(sources.select("source", "rank").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = running_total(keyed, "rank", "digest", ["doc_id", "size"], "size", rows, "before").join(
        sources.select("rank", "source_size", "target", "pieces"), "rank"
    )
    middle = lambda p: 2 * (p * F.col("source_size") + F.col("before")) + F.col("size")
    passes = F.filter(
        F.array(*[F.lit(p).cast("long") for p in range(most)]),
        lambda p: (F.col("size") > 0) & (middle(p) < 2 * F.col("target")),
    )
    return (
        placed.withColumn("positions", F.transform(passes, lambda p: position(middle(p) / (2 * F.col("target")), F.col("pieces"))))
        .withColumn("taken", F.col("size") * F.size("positions"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "positions")
    )


def by_first_position(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` range-sorted by their first position; documents not taken come last."""
    first = F.get("positions", 0).asc_nulls_last()
    return mixed.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def training_order(docs: DataFrame, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them, range-sorted by position.

    Rows find their places by doc_id and size.  Rows with both equal, which the mix treats alike,
    are numbered, and the k-th takes the places of the k-th; all others are joined as they are.
    """
    mixed = mix(docs, most).select("doc_id", "size", "positions")
    alike = cut(mixed.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.first("positions").alias("positions")))
    single = alike.filter("n = 1").select(F.col("doc_id").alias("__id"), F.col("size").alias("__n"), F.lit(1).alias("__k"), "positions")
    repeated = mixed.join(alike.filter("n > 1").select(F.col("doc_id").alias("d"), F.col("size").alias("s")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("s")))
    numbers = Window.partitionBy("doc_id", "size").orderBy("positions")
    places = single.unionByName(
        repeated.select(F.col("doc_id").alias("__id"), F.col("size").alias("__n"), F.row_number().over(numbers).alias("__k"), "positions")
    ).filter(F.size("positions") > 0)
    sized = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), word_count(F.col("text")).alias("__size"))
    many = alike.filter("n > 1").select(F.col("doc_id").alias("__d"), F.col("size").alias("__s"))
    same = F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__size") == F.col("__s"))
    numbered_rows = sized.join(many, same, "left_semi").withColumn(
        "__at", F.row_number().over(Window.partitionBy("__doc", "__size").orderBy("__row.text"))
    )
    rows = sized.join(many, same, "left_anti").withColumn("__at", F.lit(1)).unionByName(numbered_rows)
    met = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__size") == F.col("__n")) & (F.col("__at") == F.col("__k"))
    ordered = rows.join(places, met).select("__row", F.explode("positions").alias("__position"))
    return ordered.repartitionByRange("__position", "__row.doc_id").sortWithinPartitions("__position").select("__row.*")
