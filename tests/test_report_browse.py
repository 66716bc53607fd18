from chatloom.operators import report


def test_whole_messages_and_last_page(spark):
    rows = [(1, i, "01/07/2025", "A", "x" * 300 + f" Night {i}") for i in range(25)]
    m = spark.createDataFrame(rows, "chat_id BIGINT, msg_id BIGINT, date STRING, sender STRING, message STRING")
    got = report.browse(m, 99, 10, text="night").collect()
    assert [r["msg_id"] for r in got] == [20, 21, 22, 23, 24] and got[0]["message"] == "x" * 300 + " Night 20"
    assert (got[0]["total"], got[0]["page"], got[0]["total_pages"]) == (25, 3, 3)
    assert [r["msg_id"] for r in report.browse(m, -1, 10, sender="a").collect()] == list(range(10))
    assert report.browse(m, 3, text="absent").count() == 0
