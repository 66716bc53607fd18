from chatloom.operators.badrows import failed_records, strict_load

CASES = {
    "01/02/2024,10:20,Ana,hello": None,
    '"01/02/2024","10:20","Ana","say ""hi"", then\ngo"': None,
    '01/02/2024,10:20,Ana,""""': None,
    '01/02/2024,10:20,"Ana,hello': "quoting",
    '01/02/2024,10:20,Ana,"hello" you': "quoting",
    '01/02/2024,10:20,Ana,he said "no"': "quoting",
    '01/02/2024,10:20,Ana, "hello"': "quoting",
    "01/02/2024,10:20,Ana,hello, you": "columns",
    "01/02/2024,10:20,Ana": "columns",
    "": "columns",
    "31/02/2024,10:20,Ana,hello": "date",
    "1/2/2024,99:20,Ana,hello": "date",
    "01/02/2024,24:00,Ana,hello": "time",
    "01/02/2024,10:20, ,hello": "sender",
    "01/02/2024,10:20,a:b,hello": "sender",
    f"01/02/2024,10:20,{'x' * 61},hello": "sender",
    "01/02/2024,10:20,Ana,": "message",
    '01/02/2024,10:20,Ana," ​\n"': "message",
    f'01/02/2024,10:20,Ana,"{"x" * 200_000}{chr(34) * 2000}"': None,
    '01/02/2024,10:20,Ana,"a\x01b,c"': None,
}


def test_reasons_and_the_loaded_rest(spark):
    rows = [(i, r) for i, r in enumerate(CASES)] + [(100, None), (0, "31/02/2024,10:20,Ana,hello"), (None, "x"), (None, "01/02/2024,10:20,Ana,hello")]
    raw = spark.createDataFrame([(*r, "s", "old") for r in rows], "raw_id BIGINT, record STRING, _offset STRING, reason STRING")
    failed = sorted(((r["raw_id"], r["reason"]) for r in failed_records(raw).collect()), key=str)
    want = [(i, reason) for i, reason in enumerate(CASES.values()) if reason] + [(100, "columns"), (0, "date"), (None, "columns")]
    assert failed == sorted(want, key=str)
    loaded = {r["raw_id"]: r for r in strict_load(raw).filter("raw_id is not null").collect()}
    assert loaded[1]["message"] == 'say "hi", then\ngo' and loaded[2]["message"] == '"' and loaded[19]["message"] == "a\x01b,c"
    assert "_offset" in failed_records(raw).columns
    assert failed_records(raw.limit(0)).count() == 0
