from chatloom.plans.engine_queries import QUERIES


def test_a_file_over_ten_megabytes_comes_back_whole(spark, tmp_path):
    text = "concat('text ', id, repeat(' word', 220), if(id % 3 = 0, concat('\\n', 'more\\r\\n', 'last ', id), ''))"
    rows = spark.range(12_000).selectExpr("id AS row_id", "1L AS chat_id", "id AS msg_id", "1L AS export_id", "'x' AS date", "TIMESTAMP_NTZ'2025-07-01 10:00:00' + make_dt_interval(0, 0, id) AS ts", "'Ana' AS sender", f"{text} AS message", "false AS is_system")
    rows.write.parquet(f"{tmp_path}/messages.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # many splits of one file
    try:
        got = QUERIES["source_round_trip"](spark, str(tmp_path)).select("id", "message").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {i: f"text {i}" + " word" * 220 + (f"\nmore\nlast {i}" if i % 3 == 0 else "") for i in range(12_000)}
    assert len(got) == 12_000 and {r["id"]: r["message"] for r in got} == want
