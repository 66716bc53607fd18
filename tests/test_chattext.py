import pytest
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.functions.textform import normal_form


def each(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_masks(spark):
    cases = {
        "call +91 98765 43210 now": "call +91 XXXXX XXXXX now", "call +919876543210": "call +91XXXXXXXXXX", "9876543210": "XXXXXXXXXX",
        "me@mail.example.org.": "me@XXXXX.", "otp is 482913": "otp is XXXXXX", "card 1234-5678-9012-3456": "card XXXX-XXXX-XXXX-XXXX",
        "at 10:30 in room 12": "at 10:30 in room 12", "rs 500 to ana@okaxis": "rs 500 to ana@XXXXX", None: None,
    }
    got = each(spark, list(cases), ct.masked)
    assert got == list(cases.values())
    assert each(spark, got, ct.masked) == got


def test_stems(spark):
    cases = {"running": "run", "went": "go", "stopped": "stopp", "tried": "try", "boxes": "box", "cats": "cat", "class": "class", "station": "sta", "slowly": "slow", "ate": "ate", "swimming": "swim"}
    assert each(spark, list(cases), ct.stem) == list(cases.values())


def test_tokens_and_answers(spark):
    assert each(spark, ["I can't goooo, well-known"], ct.tokens) == [["i", "cannot", "goo", "well-known"]]
    assert each(spark, ["haan", "nope never", "let us see about it", None], ct.short_answer) == [1, -1, 0, 0]
    assert each(spark, ["ab", "", "This message was deleted", "hello"], ct.quality) == [0.5, 0.0, 0.1, 1.0]


def test_similarity(spark):
    df = spark.createDataFrame([("kitchen", "kitchne"), ("cat", "bat"), ("balcony", "balconi"), ("pottery", "mountain")], "a STRING, b STRING")
    got = [r[0] for r in df.select(ct.fuzzy(F.col("a"), F.col("b"))).collect()]
    assert got[1] is None and got[3] is None and got[2] == pytest.approx(1 - 1 / 7)
    assert df.limit(1).select(ct.dice(F.col("a"), F.col("a"))).first()[0] == 1.0


def test_one_form():
    assert normal_form("Ivо  Ｕlnеston​ ") == "ivo ulneston"
    assert normal_form("Sofía") == normal_form("SOFÍA") == "sofía"
    assert normal_form("ﬁnal Straße") == "final strasse"
    assert normal_form(None) is None and normal_form("") == ""
    family = "👨‍👩‍👧 ❤️"
    assert normal_form(family) == family
    assert normal_form("привeт") == "привет"  # a Latin letter in a Cyrillic word
    once = normal_form("Ａ­b ﬂ Ω Ǆ İ")
    assert normal_form(once) == once
