import random

from chatloom.llm.threads import broken_links, conversations, messages_in_chains, rebuild, resolve_parents, turns
from chatloom.session import materialize

ROWS = "chat_id BIGINT, msg_id BIGINT, minute BIGINT, person STRING, visible BOOLEAN, system BOOLEAN"


def test_pointers(spark):
    chain = [(i, i - 1 if i % 10 else None) for i in range(40)]
    rows = [*chain, (100, 999), (101, 100), (200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (None, 1), (5, 4)]
    got = {r["node"]: (r["root"], r["depth"], r["state"]) for r in resolve_parents(spark.createDataFrame(rows, "n BIGINT, p BIGINT"), "n", "p").collect()}
    assert all(got[i] == (i - i % 10, i % 10, "ok") for i in range(40))
    assert got[100] == (100, 0, "orphan") and got[101] == (100, 1, "orphan")
    assert all(got[n] == (None, None, "cycle") for n in (200, 201, 202, 203, 300))
    assert resolve_parents(spark.createDataFrame([], "n BIGINT, p BIGINT"), "n", "p").count() == 0


def brute(rows, gap=120):
    keys, by = {(c, m) for c, m, *_ in rows}, {}
    for c, m, minute, who, seen, system in {(r[0], r[1]): r for r in rows}.values():
        if not system and minute is not None:
            by.setdefault(c, []).append((minute, m, who if seen else None))
    out = []
    for c, msgs in by.items():
        msgs.sort(key=lambda x: x[:2])
        start = 0
        for i in range(1, len(msgs) + 1):
            if i == len(msgs) or msgs[i][0] - msgs[i - 1][0] >= gap:
                part = msgs[start:i]
                ids = [m for _, m, _ in part]
                if len({w for *_, w in part if w}) >= 2 and all((c, k) in keys for k in range(min(ids), max(ids) + 1)):
                    out.append((c, ids[0], ids[-1], len(ids), ids))
                start = i
    return sorted(out)


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for c in (1, 2, 3):
        minute = 0
        for m in range(400):
            minute += rng.choice([0, 1, 2, 5, 40, 119, 120, 300]) if rng.random() < 0.3 else rng.randrange(3)
            if rng.random() > 0.01:
                rows.append((c, m, None if rng.random() < 0.02 else minute - rng.choice([0, 0, 0, 1]), rng.choice(["a", "b", None]), rng.random() < 0.8, rng.random() < 0.05))
    df = materialize(spark.createDataFrame(rows + rows[:30], ROWS), "rows")
    messages, runs, links = rebuild(df)
    want = brute(rows)
    kept = conversations(runs).filter("kept")
    assert sorted(tuple(r) for r in kept.select("chat_id", "first_msg_id", "last_msg_id", "n_messages").collect()) == [w[:4] for w in want]
    got = turns(messages, runs)
    order = {}
    for r in sorted(got.collect(), key=lambda r: r["turn"]):
        order.setdefault((r["chat_id"], r["first_msg_id"]), []).append((r["turn"], r["msg_id"]))
    assert order == {(w[0], w[1]): list(enumerate(w[4], 1)) for w in want}


    numbers = {(r["chat_id"], r["state"]): r["n"] for r in broken_links(links).filter("kind = 'number'").collect()}
    ids = {c: sorted({r[1] for r in rows if r[0] == c}) for c in (1, 2, 3)}
    assert {c: numbers.get((c, "orphan"), 0) for c in ids} == {c: sum(b - a > 1 for a, b in zip(i, i[1:], strict=False)) for c, i in ids.items()}


def test_chains_end_at_absent_numbers_and_blocks(spark):
    ids = [0, 1, 5, 4095, 4096, 9000, 9001, 5]
    df = spark.createDataFrame([(1, i, None, None, False, i == 1) for i in ids], ROWS)
    assert {r["msg_id"]: r["chain"] for r in messages_in_chains(df).collect()} == {0: 0, 1: 0, 5: 5, 4095: 4095, 4096: 4096, 9000: 9000, 9001: 9000}
    links = rebuild(df)[2]
    # the chain from 4096 goes on from the one that ends with 4095
    assert {r["node"]["at"]: (r["root"]["at"], r["state"]) for r in links.collect()} == {1: (1, "ok"), 5: (5, "orphan"), 4095: (4095, "orphan"), 4096: (4095, "orphan"), 9001: (9001, "orphan")}


def test_no_rows(spark):
    messages, runs, links = rebuild(spark.createDataFrame([], ROWS))
    assert conversations(runs).count() == 0 and turns(messages, runs).count() == 0 and links.count() == 0
