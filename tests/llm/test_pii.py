import pytest

from chatloom.llm.pii import find_pii, find_spans, known_given_names, luhn, mod97, redact, redact_column, verhoeff

NAMES = frozenset({"ana", "bruno"})
CASES = [
    ("write to ana.b+chat@mail.example.org.", [("email", "ana.b+chat@mail.example.org")]),
    ("mail: ana (at) inbox (dot) test now", [("email", "ana (at) inbox (dot) test")]),
    ("ana at inbox dot test", [("email", "ana at inbox dot test")]),
    ("drop it at H.No. 8-4/50, Lotus Tank Street, Tarnholt 036701", [("address", "H.No. 8-4/50, Lotus Tank Street, Tarnholt 036701")]),
    ("we moved to Flat 9C, 55 Old Foundry Street,\nNorvik 52818 - ok", [("address", "Flat 9C, 55 Old Foundry Street,\nNorvik 52818")]),
    ("ahora en Calle Pozo Hondo 68, 02420 Tarnholt.", [("address", "Calle Pozo Hondo 68, 02420 Tarnholt")]),
    ("call +44 7700 900 118 tonight", [("phone", "+44 7700 900 118")]),
    ("(296) 555-0113. ok", [("phone", "(296) 555-0113")]),
    ("５５６５４０５６９２ please", [("phone", "５５６５４０５６９２")]),
    ("passport or id no 0226-0154-1129, X03036766 and EWMZJ9905L", [("id_number", "0226-0154-1129"), ("id_number", "X03036766"), ("id_number", "EWMZJ9905L")]),
    ("card 4111 1111 1111 1111", [("id_number", "4111 1111 1111 1111")]),
    ("Ana B. Tordeshi's parcel is with me", [("name", "Ana B. Tordeshi")]),
    ("ask for A­na Tordeshi at the desk", [("name", "A­na Tordeshi")]),
    ("order 8051-49, parcel TRK281222863837, INV-2026-33883, room 1045, 84955 km, 10:21-17:19, ₹45,094, v8.16.0", []),
    ("see https://ana@x.example.org/5556540569 and @ana_55, Monsoon Fest 2019, Harbour Line 27, Ana", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(text, want):
    spans = find_spans(text, NAMES)
    assert [(k, p) for k, p, _, _ in spans] == want
    assert all(text[a:b] == p for _, p, a, b in spans)


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert verhoeff("2363") and not verhoeff("2364")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")


def test_rows(spark):
    rows = [(1, "call +44 7700 900 118 or ana@x.example now"), (2, "nothing here"), (3, None), (4, ""), (5, "word " * 20_000 + "ana@x.example")]
    df = spark.createDataFrame(rows, "id INT, text STRING").selectExpr("*", "'x' AS found")
    got = {r["id"]: [s["piece"] for s in r["found"]] for r in find_pii(df, "text", NAMES).collect()}
    assert got == {1: ["+44 7700 900 118", "ana@x.example"], 5: ["ana@x.example"]}
    clean = {r["id"]: r["text_redacted"] for r in redact_column(df, "text", NAMES).collect()}
    assert clean[1] == "call [PHONE] or [EMAIL] now" and clean[2] == "nothing here" and clean[3] is None and clean[4] == ""
    assert redact("ana", []) == "ana"
    assert find_pii(df.limit(0), "text").count() == 0


def test_rare_names_are_joined(spark):
    people = [(n,) for n in ("Ana Lopez", "Ana Silva", "Bruno Costa", "Bruno Dias", "Ana Reis", "Once Only")]
    names = known_given_names(spark.createDataFrame(people, "sender STRING"))
    rows = [(1, "saw Bruno Tordeshi, then Ana Tordeshi"), (2, "saw Bruno Tordeshi and Once Seldom"), (3, "nobody"), (4, None), (2, "saw Bruno Tordeshi and Once Seldom")]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    whole = {(r["id"], r["text_redacted"]) for r in redact_column(df, "text", names).collect()}
    assert whole == {(1, "saw [NAME], then [NAME]"), (2, "saw [NAME] and Once Seldom"), (3, "nobody"), (4, None)}
    for most in (0, 1):
        assert {(r["id"], r["text_redacted"]) for r in redact_column(df, "text", names, most).collect()} == whole
        assert sorted(r["id"] for r in find_pii(df, "text", names, most).collect()) == [1, 2, 2]
