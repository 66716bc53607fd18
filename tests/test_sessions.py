import random

from chatloom.operators.sessions import SessionTable, local_sessions
from chatloom.session import scratch_path

EVENTS = "chat_id BIGINT, person STRING, msg_id BIGINT, minute BIGINT"


def brute(events, gap=120):
    out, by = [], {}
    for chat, person, msg, minute in {(e[0], e[2]): e for e in sorted(events, key=lambda e: -(e[3] if e[3] is not None else 0)) if e[3] is not None}.values():
        by.setdefault((chat, person), []).append((minute, msg))
    for (chat, person), rows in by.items():
        rows.sort()
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] - rows[i - 1][0] >= gap:
                out.append((chat, person, rows[start][1], rows[i - 1][1], i - start))
                start = i
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("chat_id", "person", "first_msg_id", "last_msg_id", "n_messages").collect()), key=str)


def test_batches_in_any_order_give_the_same_sessions(spark):
    rng = random.Random(5)
    events = [(c, rng.choice(["a", "b", None]), m, rng.randrange(0, 9000)) for c in (1, 2) for m in range(150)]
    batches = [[], [], []]
    for e in events:
        batches[rng.randrange(3)].append(e)
    batches[2] += batches[0][:20]  # loaded again
    batches[1].append((1, "a", 999, None))
    table = SessionTable(spark, scratch_path(spark, "sessions"), compact_after=3)
    for b in batches:
        table.apply(spark.createDataFrame(b, EVENTS))
    assert found(table.read()) == brute(events)


def test_bridging_and_the_exact_gap(spark):
    table = SessionTable(spark, scratch_path(spark, "sessions"))
    assert table.read().count() == 0
    table.apply(spark.createDataFrame([(1, "a", 1, 0), (1, "a", 3, 200)], EVENTS))
    assert len(found(table.read())) == 2
    table.apply(spark.createDataFrame([(1, "a", 2, 100)], EVENTS))
    assert found(table.read()) == [(1, "a", 1, 3, 3)]
    table.apply(spark.createDataFrame([(1, "a", 4, 320)], EVENTS))  # 120 minutes later: a new session
    assert found(table.read()) == [(1, "a", 1, 3, 3), (1, "a", 4, 4, 1)]


def test_two_writers_lose_no_batch(spark):
    path = scratch_path(spark, "sessions")
    one, other = SessionTable(spark, path), SessionTable(spark, path)
    one.apply(spark.createDataFrame([(1, "a", 1, 0)], EVENTS))
    commit = one._commit

    def late(version, manifest):
        one._commit = commit
        other.apply(spark.createDataFrame([(1, "a", 2, 60)], EVENTS))  # commits the same version first
        return commit(version, manifest)

    one._commit = late
    one.apply(spark.createDataFrame([(1, "a", 3, 100), (2, None, 1, 5)], EVENTS))
    assert one.version() == 3
    assert found(one.read()) == [(1, "a", 1, 3, 3), (2, None, 1, 1, 1)]


def test_a_batch_writes_what_it_changes(spark):
    table = SessionTable(spark, scratch_path(spark, "sessions"))
    table.apply(spark.createDataFrame([(c, "a", 1, 0) for c in range(500)] + [(1, "b", 2, 5000)], EVENTS))
    table.apply(spark.createDataFrame([(7, "a", 2, 50), (8, "b", 3, 9000)], EVENTS))
    newest = table._manifest(table.version())["sessions"][-1]
    rows = spark.read.parquet(newest)
    assert sorted((r["chat_id"], r["dead"], r["n_messages"]) for r in rows.collect()) == [(7, False, 2), (7, True, 1), (8, False, 1)]
    assert table.read().count() == 502
    table.compact()
    assert table.read().count() == 502 and table._rows(table._manifest(table.version())["sessions"], table.sessions).count() == 502
    table.apply(spark.createDataFrame([(7, "a", 2, 50)], EVENTS))  # counted before
    assert table.version() == 3


def test_no_events(spark):
    assert local_sessions(spark.createDataFrame([], EVENTS)).count() == 0
    assert local_sessions(spark.createDataFrame([(1, "a", 1, None)], EVENTS)).count() == 0
