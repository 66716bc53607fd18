from datetime import datetime
from zoneinfo import ZoneInfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chatloom.operators.instants import resolve_instants

ROWS = "row_id BIGINT, export_id BIGINT, date STRING, time STRING"
EXPORTS = "export_id BIGINT, device_zone STRING, date_order STRING, exported_at TIMESTAMP"
AT = datetime(2025, 1, 10)
SET = [(1, "Europe/Berlin", "dmy", AT), (2, "America/New_York", "mdy", AT), (3, None, None, AT), (4, "Europe/Berlin", None, AT), (5, "Asia/Kolkata", None, AT)]


def resolved(spark, stamps, exports=SET):
    rows = [(i, *s) for i, s in enumerate(stamps)]
    out = resolve_instants(spark.createDataFrame(rows, ROWS), spark.createDataFrame(exports, EXPORTS)).collect()
    return [(r["stamp_status"], r["utc_second"]) for r in sorted(out, key=lambda r: r["row_id"])]


def utc(*parts, zone="UTC"):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp())


def test_forms(spark):
    stamps = [
        (1, "03/05/2024", "10:20"), (2, "03/05/2024", "10:20"), (1, "3 May 2024", "9:05:07 p.m."), (2, "May 3, 2024", "12:15AM"),
        (1, "2024-05-03T10:20:30Z", None), (1, "2024/05/03", "10.20 +0530"), (1, "03.05.24", "23:59:59.999"), (1, "1714731000", None),
        (1, "1714731000999", ""), (1, "०३/०५/२०२४", "１０：２０ ＰＭ"), (1, "03/05/2024", "10:20 UTC-3:30"), (2, "5/3/24", "10:20 PDT"), (1, "3/5/24", "10⁠:20 рm"),
    ]
    want = [
        utc(2024, 5, 3, 8, 20), utc(2024, 3, 5, 15, 20), utc(2024, 5, 3, 19, 5, 7), utc(2024, 5, 3, 4, 15),
        utc(2024, 5, 3, 10, 20, 30), utc(2024, 5, 3, 4, 50), utc(2024, 5, 3, 21, 59, 59), 1714731000,
        1714731000, utc(2024, 5, 3, 20, 20), utc(2024, 5, 3, 13, 50), utc(2024, 5, 3, 17, 20), utc(2024, 5, 3, 20, 20),
    ]
    assert resolved(spark, stamps) == [("resolved", w) for w in want]


def test_what_names_no_instant(spark):
    stamps = [
        (1, None, "10:20"), (1, "03/05/2024", None), (1, " ", ""), (1, "31/02/2024", "10:20"), (1, "03/05/2024", "24:61"), (1, "03/05/2024", "13:00 PM"),
        (1, "soon", "10:20"), (1, "03/05/2024", "noon-ish"), (1, "31/03/2024", "02:30"), (1, "27/10/2024", "02:30"), (1, "27/10/2024", "02:30 +0100"),
        (9, "2024-05-03", "10:20"), (9, "2024-05-03", "10:20Z"), (3, "5 May 2024", "10:20"), (None, "5 May 2024", "10:20"),
    ]
    status = [s for s, _ in resolved(spark, stamps)]
    assert status == ["missing", "missing", "missing", "impossible", "impossible", "impossible", "unreadable", "unreadable", "skipped", "repeated", "resolved", "no_zone", "resolved", "no_zone", "no_zone"]


def test_order_from_the_source_itself(spark):
    # one date over 12 settles the order of its source, days in a row do too; a lone date that reads both ways stays open
    stamps = [(4, "05/06/2024", "10:00"), (4, "05/13/2024", "10:00"), (4, "07/07/2024", "10:00"), (5, "04/06/2024", "10:00"), *[(6, f"0{d}/09/2024", "10:00Z") for d in range(1, 8)]]
    got = resolved(spark, stamps, [*SET, (6, None, None, AT)])
    assert got[0] == ("resolved", utc(2024, 5, 6, 8)) and got[2][0] == "resolved"
    assert got[3][0] == "order_open"
    assert got[4:] == [("resolved", utc(2024, 9, d, 10)) for d in range(1, 8)]


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 1, "03/05/2024", "10:20", "x", "y", 3)], ROWS + ", device_zone STRING, _d STRING, utc_second INT")
    exports = spark.createDataFrame(SET, EXPORTS)
    out = resolve_instants(rows, exports)
    row = out.first()
    assert row["device_zone"] == "x" and row["_d"] == "y" and row["utc_second"] == utc(2024, 5, 3, 8, 20)
    assert resolve_instants(rows.limit(0), exports.limit(0)).count() == 0
    assert resolve_instants(rows, exports.limit(0)).first()["stamp_status"] in ("no_zone", "order_open")


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(2015, 1, 1), datetime(2030, 1, 1)), min_size=1, max_size=40))
def test_zone_rules_against_zoneinfo(spark, walls):
    zone = ZoneInfo("Europe/Berlin")
    got = resolved(spark, [(1, w.strftime("%d/%m/%Y"), w.strftime("%H:%M:%S")) for w in walls])
    for wall, (status, second) in zip(walls, got, strict=True):
        wall = wall.replace(microsecond=0)
        both = {int(wall.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1)}
        real = {s for s in both if datetime.fromtimestamp(s, zone).replace(tzinfo=None) == wall}
        assert (status, second) == (("resolved", real.pop()) if len(real) == 1 else ("repeated", None) if real else ("skipped", None))
