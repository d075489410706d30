from tests.llm.conftest import words
from tidemark.llm.sharding import assign_shards, longest_first


def test_longest_first():
    placed = longest_first([(1, 7), (2, 5), (3, 4), (4, 3), (5, 3)], 2)
    loads = [sum(s for k, s in [(1, 7), (2, 5), (3, 4), (4, 3), (5, 3)] if placed[k] == i) for i in (0, 1)]
    assert sorted(loads) == [10, 12]
    assert longest_first([], 3) == {}


def test_shards(docs):
    rows = [(i, words(i % 700, 20 + i % 30)) for i in range(3000)] + [(4000 + i, "copy " * 40) for i in range(400)]
    rows += [(None, "x"), (None, "x"), (7, None), (8, ""), (1, words(1, 21)), (1, words(1, 21))]
    df = docs(rows)
    out = assign_shards(df)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    assert len(got) == len(rows)
    shards, slots, loads = {}, {}, {}
    for r in got:
        shards.setdefault(r.text or "", set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + len((r.text or "").encode()) + 1
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())
    assert assign_shards(df.limit(0)).count() == 0


def test_a_group_larger_than_a_share(docs):
    got = assign_shards(docs([(i, "copy " * 40) for i in range(300)] + [(1000 + i, words(i, 40)) for i in range(200)])).collect()
    own = {r.shard for r in got if r.text.startswith("copy")}
    assert len(own) == 1 and not any(r.shard in own for r in got if not r.text.startswith("copy"))
