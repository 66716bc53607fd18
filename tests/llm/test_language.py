import math
from collections import Counter, defaultdict

from chatloom.llm.language import MAX_ORDER, ContextTrees, detect, fit_languages, letters_only, lines_to_score, score_texts

EN = ["we should meet near the old mill before the concert starts", "please do not forget to water the plants today", "the train was late again so we walked home"]
ES = ["nos vemos en la estación antes de que empiece el concierto", "por favor no olvides regar las plantas hoy", "el tren llegó tarde otra vez y volvimos a pie"]


def brute_bits(train, text):
    """Code length by the definition: escape method C, no exclusions."""
    counts = defaultdict(Counter)
    for t in train:
        data = f" {t} ".encode()
        for i in range(len(data)):
            for k in range(min(i, MAX_ORDER) + 1):
                counts[data[i - k : i]][data[i]] += 1
    total, data = 0.0, f" {text} ".encode()
    for i in range(len(data)):
        for k in range(min(i, MAX_ORDER), -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if seen[data[i]]:
                total -= math.log2(seen[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    trees = ContextTrees.fit(EN + ES, ["en"] * 3 + ["es"] * 3)
    texts = ["the old train", "el tren viejo", "zzz ж", ""]
    bits = trees.code_lengths(texts)
    for text, (en, es) in zip(texts, bits, strict=True):
        assert abs(en - brute_bits(EN, text)) < 0.05 and abs(es - brute_bits(ES, text)) < 0.05


def test_held_out_lines_and_wrong_labels(spark):
    rows = [(i, (EN if i % 2 else ES)[i % 3], "en" if i % 2 else "es") for i in range(60)] + [(100, EN[0], "es"), (101, ES[0], None)]
    df = spark.createDataFrame(rows, "row_id BIGINT, message STRING, lang STRING")
    trees = fit_languages(df, "message", "lang")
    held_out = spark.createDataFrame([(1, "should we water the old plants"), (2, "¿llegó el tren a la estación?"), (3, ""), (4, None), (5, "123 😀"), (6, EN[0])], "i INT, message STRING")
    got = {r["i"]: r["detected"] for r in detect(held_out, "message", trees).collect()}
    assert got == {1: "en", 2: "es", 3: None, 4: None, 5: None, 6: "en"}


def test_lines(spark):
    rows = [(1, "en", "one two three four five\nshort\r\nsix seven eight nine ten", False, None, False), (2, None, None, False, False, False), (3, "en", "a b c d e", True, False, False)]
    df = spark.createDataFrame(rows, "row_id BIGINT, lang STRING, message STRING, is_system BOOLEAN, is_media BOOLEAN, is_deleted BOOLEAN")
    assert sorted((r["row_id"], r["line_no"]) for r in lines_to_score(df).collect()) == [(1, 1), (1, 3)]


def test_no_labels_and_letters(spark):
    df = spark.createDataFrame([(1, "hello there you", None)], "row_id BIGINT, message STRING, lang STRING")
    assert score_texts(fit_languages(df, "message", "lang"), ["hello"]) == [(None, None)]
    assert letters_only("See https://x.example/a me@x.example ５５５ Ｈello 😀!") == "see hello"
