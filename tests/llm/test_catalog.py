from chatloom.llm import catalog, language


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_both_texts_are_redacted(spark, tmp_path):
    messages = [(1, "Ana Tordeshi", "call +44 7700 900 118 now"), (2, None, "nothing here"), (3, "Ana Tordeshi", None), (4, "x", "")]
    facts = [(1, "mail ana@x.example"), (2, None)]
    at = write(spark, tmp_path, messages=(messages, "row_id BIGINT, sender STRING, message STRING"), person_facts=(facts, "fact_id BIGINT, evidence STRING"))
    got = {(r["tbl"], r["id"]): r["text_redacted"] for r in catalog.p5_redacted(spark, at).collect()}
    assert got == {
        ("messages", 1): "call [PHONE] now", ("messages", 2): "nothing here", ("messages", 3): None, ("messages", 4): "",
        ("person_facts", 1): "mail [EMAIL]", ("person_facts", 2): None,
    }


def test_all_fields_come_out_in_one_form(spark, tmp_path):
    messages = [(1, "１２：３０", "Ｈi", "Ivо says"), (2, "12:30", "Hi", "ivo says"), (3, None, None, None), (4, "", " ", "")]
    at = write(spark, tmp_path, messages=(messages, "row_id BIGINT, time STRING, sender STRING, message STRING"))
    got = {r["row_id"]: (r["time_normal"], r["sender_normal"], r["message_normal"]) for r in catalog.p2_normalised(spark, at).collect()}
    assert got == {1: ("12:30", "hi", "ivo says"), 2: ("12:30", "hi", "ivo says"), 3: (None, None, None), 4: ("", "", "")}


def test_every_line_has_a_language(spark, tmp_path):
    en, es = "we should meet near the old mill tonight", "nos vemos en la estación antes del concierto"
    messages = [(i, (en, es)[i % 2] + f" {'abcdefghij'[i]}", ("en", "es")[i % 2], False) for i in range(10)]
    messages += [(10, f"{en}\nestación\n\n😀", None, False), (11, None, None, False), (12, "the old mill", "en", True)]
    at = write(spark, tmp_path, messages=(messages, "row_id BIGINT, message STRING, lang STRING, is_system BOOLEAN"))
    rows = {(r["row_id"], r["line_no"]): (r["lang"], r["confidence"]) for r in catalog.p4_lines(spark, at).collect()}
    assert set(rows) == {(i, 1) for i in range(10)} | {(10, n) for n in (1, 2, 3, 4)} | {(12, 1)}
    assert [rows[10, n][0] for n in (1, 2, 3, 4)] == ["en", "es", None, None] and rows[12, 1][0] == "en"
    assert all((lang is None) == (sure is None) and (sure is None or 0.5 <= sure <= 1) for lang, sure in rows.values())


def test_copies_do_not_shrink_the_fit(spark, monkeypatch):
    sizes = []
    fit = language.ContextTrees.fit
    monkeypatch.setattr(language.ContextTrees, "fit", lambda texts, labels: sizes.append(len(texts)) or fit(texts, labels))
    words = "amber birch cedar delta ember fjord grove haven".split()
    rows = [(f"{a} {b} {c}", "en") for a in words for b in words for c in words[:2] for _ in range(20)]
    rows += [(f"{a} {b} {words[0]}", "es") for a in words for b in words]  # a wrong label on half of the texts
    df = spark.createDataFrame(rows, "message STRING, lang STRING")
    language.fit_languages(df, "message", "lang", sample_rows=128)
    assert sizes[-1] >= 120
