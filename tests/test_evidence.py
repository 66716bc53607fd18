import pytest

from chatloom.operators import evidence
from chatloom.operators.questions import analyse, suggestions

CHAT = [
    ("Mira", "anyone up for a pottery class this month"), ("Tom", "do you like pottery?"), ("Mira", "yeah"), ("Mira", "I started last spring, the wheel is great"), ("Tom", "the garden needs water"),
    ("Mira", "I don't follow football at all"), ("Tom", "we watched the football final"), ("Tom", "football again tonight"), ("Ana", "who brings the projector"), ("Tom", "I used to like coffee"), ("Tom", "switched to tea now, coffee keeps me awake"),
    ("Ana", "the hiking trip was lovely"), ("Ana", "we hiked to the lake"), ("Mira", "photos of the lake please"), ("Tom", "ok"), ("Tom", "ok then"), ("Tom", "right"), ("Tom", "done"), ("Ana", "Mira promised a poem"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(c, i, f"0{1 + i // 6}/05/2025", who, text) for c in (1, 2) for i, (who, text) in enumerate(CHAT)] + [(3, 0, "01/05/2025", "Zoe", "hello there")]
    return evidence.index(spark.createDataFrame(rows, "chat_id BIGINT, msg_id BIGINT, date STRING, sender STRING, message STRING"))


def ask(spark, docs, text, **more):
    got = evidence.retrieve(docs, analyse(spark, text), **more).collect()
    assert {r["msg_id"] for r in got if r["chat_id"] == 1} == {r["msg_id"] for r in got if r["chat_id"] == 2}
    mine = sorted((r for r in got if r["chat_id"] == 1), key=lambda r: r["msg_id"])
    return [CHAT[r["msg_id"]][1] for r in mine], mine


def test_analysis(spark):
    q = analyse(spark, 'What did Mira say about the "hiking trip"?')
    assert q.topic == ["mira", "hiking", "trip"] and q.topic_stems == ["mira", "hik", "trip"] and "hiking trip" in q.phrases and q.intent == "factual"
    assert analyse(spark, "does she like tea").intent == "preference" and analyse(spark, "and then?").intent == "follow_up"
    assert analyse(spark, "").words == [] and len(suggestions(["Mira", "Tom"])) <= 6


def test_question_and_its_answer(spark, docs):
    texts, rows = ask(spark, docs, "does Mira like pottery")
    assert {"do you like pottery?", "yeah", "I started last spring, the wheel is great"} <= set(texts)
    assert rows[0]["pass"] == "strict" and rows[0]["confidence"] >= 0.85


def test_negation_contradiction_and_stems(spark, docs):
    assert "I don't follow football at all" in ask(spark, docs, "does Mira like football")[0]
    assert {"I used to like coffee", "switched to tea now, coffee keeps me awake"} <= set(ask(spark, docs, "does Tom like coffee")[0])
    assert "we hiked to the lake" in ask(spark, docs, "hiking at the lake")[0]
    scored = evidence.score(docs, analyse(spark, "does Mira like football"))
    assert {r["msg_id"] for r in scored.filter("chat_id = 1 AND polarity = -1").collect()} == {5}


def test_typos_need_the_later_passes(spark, docs):
    texts, rows = ask(spark, docs, "projectr")
    assert "who brings the projector" in texts and rows[0]["pass"] in ("relaxed", "fuzzy")


def test_many_near_words_are_compared_directly(spark, docs, monkeypatch):
    q = analyse(spark, "projectr and potery")
    looked_up = sorted(map(tuple, evidence.retrieve(docs, q).collect()))
    monkeypatch.setattr(evidence, "_near_words", lambda docs, q: None)
    assert sorted(map(tuple, evidence.retrieve(docs, q).collect())) == looked_up and looked_up


def test_person_floods_and_nothing(spark, docs):
    texts, _ = ask(spark, docs, "ok then right done", limit=100)
    assert len([t for t in texts if t in ("ok", "ok then", "right", "done")]) == 3
    assert "Mira promised a poem" in ask(spark, docs, "what was the poem Mira promised")[0] and ask(spark, docs, "zeppelin") == ([], [])
    assert evidence.retrieve(docs, analyse(spark, "")).count() == 0 and evidence.retrieve(docs.limit(0), analyse(spark, "pottery")).count() == 0


def test_vectors_and_lessons_join_in(spark, docs):
    q = analyse(spark, "ceramics")
    near = spark.createDataFrame([(1, 0, 0.9)], "chat_id BIGINT, msg_id BIGINT, similarity DOUBLE")
    found = evidence.retrieve(docs, q, similarity=near)
    assert {(r["chat_id"], r["msg_id"]) for r in found.filter("is_anchor").collect()} == {(1, 0)}
    taught = evidence.learn(found.withColumn("confidence", found["confidence"] + 1), docs, q)
    assert {r["stem"] for r in taught.collect()} == {"ceramic"}
    merged = evidence.merged_evidence(found, evidence.retrieve(docs, analyse(spark, "pottery")))
    assert merged.filter("chat_id = 1 AND msg_id = 1").count() == 1
