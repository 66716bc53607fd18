import itertools
import random

import numpy as np

from chatloom.llm.packing import bucket_bounds, fill, pack, plan_batches, token_counts
from chatloom.session import materialize


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randrange(1, 9) for _ in lengths]
        got = bucket_bounds(np.array(lengths), np.array(counts), 3)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        assert len(got) <= 3 and padding(lengths, counts, got) == best


def test_bounds_of_many_lengths():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 3000, 700))
    counts = rng.integers(1, 50, len(lengths))
    got = bucket_bounds(lengths, counts, 12)
    # the plain recurrence
    c, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = lengths * c[1:] - t[1:]
    for _ in range(11):
        cost = np.array([min([0, *cost[:j]][i] + lengths[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i]) for i in range(j + 1)) for j in range(len(lengths))])
    assert len(got) <= 12 and padding(lengths, counts, got) == cost[-1]


def test_batches_of_one_bucket():
    plan = plan_batches([3, 5, 8], [7, 4, 2], 16, mix=False)
    assert all(len(p.slots) == 1 for p in plan) and sum(p.copies for p in plan) == 2 + 2 + 1


def test_plan_uses_every_slot():
    plan = plan_batches([3, 5, 8], [7, 4, 2], 16)
    used = {b: sum(p.slots.get(b, 0) * p.copies for p in plan) for b in range(3)}
    assert used == {0: 7, 1: 4, 2: 2}
    assert all(sum(k * [3, 5, 8][b] for b, k in p.slots.items()) <= 16 for p in plan)


def test_containers(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 3, 10, 40, 99, 100, 101, 250, 1000]) if rng.random() < 0.3 else rng.randrange(1, 90) for _ in range(400)]
    docs = materialize(spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id BIGINT, n_tokens BIGINT, container STRING"), "docs")
    uses = spark.createDataFrame([("a", 100), ("b", 256), ("none", 0), (None, None)], "use_name STRING, capacity_tokens INT")
    packed = pack(docs, uses, buckets=12, salts=4)
    rows = packed.collect()
    for use, capacity in (("a", 100), ("b", 256)):
        mine = [r for r in rows if r["use_name"] == use]
        room, parts = {}, {}
        for r in mine:
            room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert max(room.values()) <= capacity
        for i, n in enumerate(sizes):
            got = sorted(parts.get(i, []))
            assert sum(k for _, k in got) == n and (n > capacity or len(got) <= 1)
            assert [s for s, _ in got] == [capacity * j for j in range(len(got))]
        assert sum(room.values()) / (len(room) * capacity) > 0.9
    assert fill(packed, uses).count() == 2
    assert pack(docs.limit(0), uses).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None)], "doc_id INT, text STRING")
    assert [r["n_tokens"] for r in token_counts(df).orderBy("doc_id").collect()] == [2, 0, 0]
