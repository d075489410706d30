import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm.mixing import mix, position, segments, training_order


def corpus():
    rows = []
    for s, n in (("a", 300), ("b", 20), ("c", 60), (None, 5), ("é", 40)):
        rows += [(len(rows) + i, words(0, 5 + (i * 7) % 40), s) for i in range(n)]
    return rows + [(None, words(0, 9), "a"), (None, words(0, 9), "a"), (7, words(0, 5), "a"), (9000, None, "b"), (9001, "", "z")]


def water_filling(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        level = rest / sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and level * w > 3 * sizes[i]}
        if not over:
            return [3 * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over


def test_targets_and_taken(docs):
    rows = corpus()
    got = mix(docs(rows)).collect()
    assert len(got) == len(rows)
    names = ["a", "b", "c", "z", "é", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    for name, size, target in zip(names, sizes, water_filling(sizes), strict=True):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= 30
        assert all(r.taken <= 3 * r["size"] and r.taken == r["size"] * len(r.positions) for r in own)
        assert all(0 <= p <= 1 for r in own for p in r.positions)
    again = mix(docs(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_order(docs):
    df = docs(corpus())
    places = {}
    for r in mix(df).collect():
        places.setdefault((r.doc_id, r["size"]), []).extend(r.positions)
    ordered = training_order(df)
    assert ordered.columns == df.columns
    taken = {}
    for r in ordered.collect():
        key = (r.doc_id, len((r.text or "").split()))
        taken[key] = taken.get(key, 0) + 1
    assert taken == {k: len(v) for k, v in places.items() if v}
    assert training_order(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0


def test_positions_invert_the_schedule(spark):
    knots = [(0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0)]
    df = spark.range(101).select((F.col("id") / 100).alias("share"), F.lit(0).alias("x"))
    column = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots])
    got = df.select("share", position(F.col("share"), segments(column)).alias("t")).collect()

    def integral(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t > t0:
                end = min(t, t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                total += (w0 + w) / 2 * (end - t0)
        return total

    for r in got:
        assert integral(r.t) / integral(1.0) == pytest.approx(r.share, abs=1e-9)
    assert [r.t for r in got] == sorted(r.t for r in got)
