from chatloom.operators import answers, facts, report, usage
from chatloom.operators.questions import question_type
from pyspark.sql import functions as F

M = "chat_id BIGINT, msg_id BIGINT, row_id BIGINT, date STRING, time STRING, ts TIMESTAMP_NTZ, sender STRING, message STRING"


def test_router_reads_english_and_hinglish():
    want = {
        "who talks more": "who_talks_most", "kaun zyada baat karta hai": "who_talks_most", "how many messages": "total", "who replies faster": "reply_speed", "who sends longer messages": "longer_messages",
        "who uses more emojis": "emoji_user", "what is the busiest day": "busiest_day", "does mira like cooking": None, "who are the participants": "participants", "top emoji": "top_emoji",
    }
    assert {q: answers.route(q) for q in want} == want


def test_minutes_and_types(spark):
    df = spark.createDataFrame([(None,), (0.25,), (12.4,), (59.6,), (60.0,), (125.2,)], "m DOUBLE")
    assert [r[0] for r in df.select(report.minutes_text(F.col("m"))).collect()] == ["N/A", "15 sec", "12 min", "60 min", "1 hr", "2 hr 5 min"]
    texts = ["who talks most", "response time?", "long messages", "who starts a conversation", "does she like tea", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(question_type(F.col("t"))).collect()]
    assert got == ["message_statistics", "response_statistics", "message_length_statistics", "conversation_statistics", "conversation_question", "conversation_question"]


def test_json_in_texts(spark):
    texts = ['```json\n{"Ana": [{"category": "food", "fact": "likes tea", "evidence": null}]}\n```', 'Sure! {"Bo": []} done', "no braces", "} {", '{"broken": ', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, json STRING")
    assert [r[0] is not None for r in df.select(facts.json_within(F.col("json"))).collect()] == [True, True, False, False, False, False, False]
    assert [tuple(r) for r in facts.facts_in_documents(df).collect()] == [(0, "Ana", 1, "food", "likes tea", None)]


def test_transcript_is_thinned_evenly(spark):
    rows = [(1, i, i, "d", "t", None, "A", f"m{i}" if i % 5 else "  ") for i in range(20)] + [(2, 0, 0, None, None, None, "B", "hi")]
    m = spark.createDataFrame(rows, M)
    whole = facts.transcript(m).orderBy("chat_id", "line_no").collect()
    assert len(whole) == 17 and whole[0]["line"] == "[d t] A: m1" and whole[-1]["line"] == "[ ] B: hi"
    assert [r["line_no"] for r in facts.transcript(m, 100).filter("chat_id = 1").orderBy("line_no").collect()] == [0, 2, 4, 6, 8, 10, 12, 14]
    assert facts.transcript(m.limit(0)).count() == 0


def test_sections_of_nothing(spark):
    m = spark.createDataFrame([], M)
    for section in (report.records, report.tiles, report.month_rhythm, report.word_cloud, report.words_by_person, lambda x: report.by_date(report.aliased(x))):
        assert section(m).count() == 0
    events = spark.createDataFrame([], "event_id BIGINT, user_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    for section in (usage.latest_by_key, usage.votes, usage.since_start):
        assert section(events).count() == 0
