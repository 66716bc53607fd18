from datetime import datetime, timedelta

from chatloom.operators import usage
from chatloom.operators.retrieval import nearest_vectors

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def test_rolling_over_slot_edges(spark):
    start = datetime(2025, 1, 1)
    rows = [(i, start + timedelta(seconds=7 * i), 1, "a" if i % 3 else "b", float(i), '{"k": "v"}') for i in range(300)] + [(999, None, 1, "a", None, "{bad")]
    df = spark.createDataFrame(rows, EVENTS)
    want = {r[0]: sum(1 for o in rows[:300] if o[3] == r[3] and timedelta(0) <= r[1] - o[1] <= timedelta(seconds=60)) for r in rows[:300]}
    assert {r["event_id"]: r["n"] for r in usage.rolling_usage(df).collect()} == want
    assert [tuple(r) for r in usage.property_counts(df).collect()] == [("k", "v", 300)]
    assert usage.rolling_usage(df.limit(0)).count() == 0


def test_nearest_vectors(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    for block in (1, 100):
        assert [(r["query_id"], r["vec_id"]) for r in nearest_vectors(df, block_rows=block).collect()] == [(50, 1)]
