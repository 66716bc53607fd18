from datetime import datetime

from chatloom.operators import report
from chatloom.plans.report_queries import QUERIES


def test_messages_without_the_old_ts_are_counted(spark, tmp_path):
    old = datetime(2025, 7, 1, 12, 0)
    rows = [
        (1, 1, 1, 1, "01/07/2025", "23:10", None, "A", "hello", False),
        (2, 1, 1, 2, "no date", "", old, "A", "hello", False),  # a copy
        (3, 1, 2, 1, "01/07/2025", "23:15", None, "B", "hi", False),
        (4, 1, 3, 1, "no date", "", old, "A", "old reading only", False),
        (5, 1, 4, 1, None, None, None, "A", "undated", False),
        (6, 1, 5, 1, "01/07/2025", "23:20", None, None, "notice", True),
        (7, 1, 6, 1, "no date", "", None, "B", "copy is dated", False),
        (8, 1, 6, 1, "02/07/2025", "10:00", None, "B", "copy is dated", False),
    ]
    schema = "row_id BIGINT, chat_id BIGINT, msg_id BIGINT, export_id BIGINT, date STRING, time STRING, ts TIMESTAMP_NTZ, sender STRING, message STRING, is_system BOOLEAN"
    exports = [(1, "Asia/Kolkata", "dmy", datetime(2025, 8, 1)), (2, "Asia/Kolkata", "dmy", datetime(2025, 8, 1))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame(exports, "export_id BIGINT, device_zone STRING, date_order STRING, exported_at TIMESTAMP_NTZ").write.parquet(f"{tmp_path}/exports.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in run("dated_coverage")] == [(1, 5, 3, 1, 1)]
    assert {r["hour"]: r["messages"] for r in run("dated_by_hour") if r["messages"]} == {17: 2, 12: 1, 4: 1}
    assert [(r["sender"], r["responses"], r["average_minutes"]) for r in run("dated_response_stats")] == [("B", 1, 5.0)]
    assert [r["days"] for r in run("dated_streaks")] == [2]
