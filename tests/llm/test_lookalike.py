import pytest

from chatloom.llm.lookalike import defects, find_lookalikes, normalise

CASES = {
    "plain text": [], "": [], "tab\tand\nbreak": [], "café naïve": [], "привет мир": [], "नमस्ते दुनिया": [], "क्‍ष": [], "👨‍👩‍👧 ❤️ 🤷‍♀️ 🏴󠁧󠁢󠁥󠁮󠁧󠁿 1️⃣": [], "…½№": [],
    "Ｈi": ["full_width"], "１２：３０": ["full_width"], "ﬁnal": ["ligature"], "a b": ["space"], "a b": ["space"], "a　b": ["space"],
    "zero​width": ["invisible"], "﻿start": ["invisible"], "so­ft": ["invisible"], "a‍b": ["invisible"], "café": ["accent_apart"],
    "й": ["accent_apart"], "Ivо": ["mixed_script"], "рm": ["mixed_script"], "Rοhan": ["mixed_script"], "привeт": ["mixed_script"],
    None: None,
}


@pytest.mark.parametrize("text", list(CASES))
def test_kinds(text):
    assert defects(text) == CASES[text]


def test_rows(spark):
    rows = [(1, "Ｈi", None, "x"), (2, "ok", "a b", "Ivо"), (2, "ok", "a b", "Ivо"), (3, None, None, None), (4, "é" * 100_000, "", "")]
    df = spark.createDataFrame(rows, "row_id INT, time STRING, sender STRING, message STRING").selectExpr("*", "1 AS field", "2 AS defects")
    got = sorted((r["row_id"], r["field"]) for r in find_lookalikes(df, "row_id", ["time", "sender", "message"]).collect())
    assert got == [(1, "time"), (2, "message"), (2, "message"), (2, "sender"), (2, "sender")]
    assert find_lookalikes(df.limit(0), "row_id", ["time"]).count() == 0
    assert {r["message_normal"] for r in normalise(df, ["message"]).collect()} == {"x", "ivo", None, ""}
