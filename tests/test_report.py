from datetime import datetime

from chatloom.operators import evidence, report, retrieval
from chatloom.operators.questions import analyse
from chatloom.operators.adjacent import running_count, with_previous

SCHEMA = "chat_id BIGINT, msg_id BIGINT, row_id BIGINT, date STRING, ts TIMESTAMP_NTZ, sender STRING, message STRING"


def chat(spark):
    t = lambda d, h, m: datetime(2025, d[1], d[0], h, m)
    rows = [
        (1, 0, 0, "01/07/2025", t((1, 7), 10, 0), "A", "Hello there friends, see https://x.example/a"),
        (1, 1, 1, "01/07/2025", t((1, 7), 10, 5), "B", "pizza tonight? 😄"),
        (1, 2, 2, "01/07/2025", t((1, 7), 10, 6), "A", "pizza pizza yes"),
        (1, 3, 3, "02/08/2025", t((2, 8), 23, 0), "B", "<Media omitted>"),
        (1, 4, 4, "02/08/2025", t((2, 8), 23, 10), "A", "done 😄😄"),
        (1, 5, 5, "02/08/2025", None, "A", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_sections(spark):
    m = chat(spark)
    o = report.overview(m).first()
    assert (o["total_messages"], o["participants"], o["links"], o["media_messages"], o["duration_days"]) == (6, 2, 1, 1, 33)
    stats = {r["sender"]: r for r in report.response_stats(m).collect()}
    assert (stats["A"]["median_minutes"], stats["A"]["responses"], stats["B"]["fastest_minutes"]) == (5.5, 2, 5.0)
    assert sorted(one(report.conversation_starters(m))) == [(1, "A", 1, 2, 50), (1, "B", 1, 2, 50)]
    assert one(report.reply_pairs(m)) == [(1, 1, "B", "A", 2), (1, 2, "A", "B", 1)]
    assert one(report.top_emojis(m)) == [(1, 1, "😄", 3)]
    assert one(report.top_words(m))[0][:4] == (1, 1, "pizza", 3)
    assert one(report.night_share(m)) == [(1, 40, 10)]
    assert one(report.streaks(m))[0][1] == 1
    assert report.by_hour(m).count() == 24


def test_empty_table(spark):
    m = chat(spark).limit(0)
    for section in (report.overview, report.response_stats, report.top_words, report.streaks, report.vibe, report.collapse_floods, report.by_hour):
        assert section(m).count() == 0
    assert retrieval.cooccurrence(m).count() == 0


def test_blocks_change_nothing(spark):
    rows = [(k, i * 3, i % 4 == 0, i) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k INT, o BIGINT, f BOOLEAN, v INT")
    for block in (1, 7, 10_000):
        got = sorted((r["k"], r["o"], r["prev"]["v"] if r["prev"] else None) for r in with_previous(df, "k", "o", ["v"], block).collect())
        assert got == [(k, i * 3, i - 1 if i else None) for k in (1, 2) for i in range(50)]
        counts = sorted((r["k"], r["o"], r["n"]) for r in running_count(df, "k", "o", "f", "n", block).collect())
        assert counts == [(k, i * 3, i // 4 + 1) for k in (1, 2) for i in range(50)]


def test_evidence_holds_the_asked_for_message(spark):
    got = evidence.retrieve(evidence.index(chat(spark)), analyse(spark, "who wants pizza tonight?"))
    best = got.orderBy("score", ascending=False).first()
    assert best["msg_id"] == 1 and best["is_anchor"]
    assert evidence.retrieve(evidence.index(chat(spark)), analyse(spark, "?")).count() == 0
