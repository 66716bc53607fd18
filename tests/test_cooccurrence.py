import random
from collections import Counter

import pyarrow as pa

from chatloom.operators import retrieval
from chatloom.operators.pairs import count_pairs

WORDS = ["kayak", "lemon", "orbit", "tulip", "zebra", "Lemons", "the", "42"]
STEMS = {"Lemons": "lemon"}


def chats(seed):
    """Chats with numbers missing, dates that change and return or are null, texts of nothing."""
    rng, rows = random.Random(seed), []
    for chat, size in ((1, 300), (2, 40), (3, 1), (4, 25)):
        at, date = rng.randrange(5), "a"
        for _ in range(size):
            at += 1 if rng.random() < 0.9 else rng.randrange(2, 60)
            date = rng.choice(["a", "b", None]) if rng.random() < 0.15 else date
            rows.append((chat, at, date, " ".join(rng.choices(WORDS, k=rng.choice([0, 0, 1, 2, 3, 9])))))
    return rows


def expected(rows, reach=2, least=2):
    counts = Counter()
    for chat in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == chat), key=lambda r: r[0])
        said = [[STEMS.get(w, w) for w in text.split() if w != "the"] for _, _, text in mine]
        run = [0]
        for one, two in zip(mine, mine[1:]):
            run.append(run[-1] + (one[1] != two[1]))
        for i, words in enumerate(said):
            near = {w for j in range(max(0, i - reach), min(len(said), i + reach + 1)) if run[j] == run[i] for w in said[j]}
            counts.update((chat, a, b) for a in words for b in near if a != b)
    return {k: n for k, n in counts.items() if n >= least}


def found(df):
    rows = df.collect()
    assert len(rows) == len({(r["chat_id"], r["a"], r["b"]) for r in rows})
    return {(r["chat_id"], r["a"], r["b"]): r["n"] for r in rows}


def test_blocks_change_no_pair(spark):
    for seed, blocks in ((1, (200, 10)), (2, (1 << 24,))):
        rows = chats(seed)
        m = spark.createDataFrame(rows, "chat_id BIGINT, msg_id BIGINT, date STRING, message STRING")
        for block in blocks:
            assert found(retrieval.cooccurrence(m, block=block)) == expected(rows)
    assert found(retrieval.cooccurrence(m, reach=1, least=3, block=50)) == expected(rows, 1, 3)


def test_portions_change_no_pair():
    rows = chats(3)
    columns = [*zip(*[(c, 0, i, True, d, " ".join(STEMS.get(w, w) for w in t.split() if w != "the")) for c, i, d, t in sorted(rows, key=lambda r: r[:2])])]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()))], names=["chat_id", "block", "msg_id", "own", "date", "stems"])
    for size, pairs, together in ((7, 5, 1), (50, 100, 2000), (1000, 1 << 21, 1 << 20)):
        out = [r for b in count_pairs(iter(table.to_batches(max_chunksize=size)), 2, 2, pairs, together) for r in b.to_pylist()]
        assert len(out) == len(expected(rows)) and {(r["chat_id"], r["a"], r["b"]): r["n"] for r in out} == expected(rows)


def test_no_pair_is_shuffled(spark):
    rng = random.Random(4)
    rows = [(1, i, "a", " ".join(f"w{rng.randrange(2000)}x" for _ in range(12))) for i in range(2000)]
    m = spark.createDataFrame(rows, "chat_id BIGINT, msg_id BIGINT, date STRING, message STRING")

    def shuffled():
        listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))

    before = shuffled()
    assert retrieval.cooccurrence(m).count() > 50_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert shuffled() - before < 2 * sum(len(r[3]) for r in rows)
