"""Queries over the general problems; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.badrows import failed_records, strict_load
from chatloom.operators.instants import resolve_instants
from chatloom.operators.sessions import sessions_of_batches
from chatloom.operators.timeline import dated_rows
from chatloom.session import materialize, scratch_path, table


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").select("row_id", "export_id", "date", "time")
    return resolve_instants(rows, table(spark, sf_dir, "exports"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark, sf_dir).filter(F.col("stamp_status") == "resolved").select("row_id", "utc_second")


def p1_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stamp doesn't name one instant, with the reason."""
    return _stamps(spark, sf_dir).filter(F.col("stamp_status") != "resolved").select("row_id", "stamp_status", "stamp_order")


def _sessions(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Sessions of dated rows; persons by their 64-bit hash, which aggregates without sorting."""
    slim = rows.filter(~F.col("system")).select("chat_id", "msg_id", "minute", "loaded_at", F.xxhash64("person").alias("person"))
    return sessions_of_batches(materialize(slim, "dated"), scratch_path(spark, "sessions"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_rows(table(spark, sf_dir, "messages"), table(spark, sf_dir, "exports"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, _dated(spark, sf_dir)).select("chat_id", "first_msg_id", "last_msg_id", "n_messages")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole session rows: person, start, end, duration in minutes, number of messages."""
    rows = materialize(_dated(spark, sf_dir), "rows")
    names = rows.select("chat_id", F.xxhash64("person").alias("person"), F.col("person").alias("name")).distinct()
    span = (F.col("end_minute") - F.col("start_minute")).alias("duration_minutes")
    found = _sessions(spark, rows).join(names, ["chat_id", "person"])
    return found.select("chat_id", F.col("name").alias("person"), "start_minute", "end_minute", span, "n_messages")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_records(table(spark, sf_dir, "raw_rows")).select("raw_id", "reason")


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows."""
    return strict_load(table(spark, sf_dir, "raw_rows")).select("raw_id", "date", "time", "sender", "message")


QUERIES = {f.__name__: f for f in (p1_found, p1_unresolved, p3_found, p3_sessions, p7_found, p7_loaded)}

_FIELDS = r"""
WITH cut AS (
  SELECT raw_id, record, string_split(record, '"') AS p FROM raw_rows
), checked AS (
  SELECT *, len(p) % 2 = 1 AND len(list_filter(range(1, len(p) + 1), lambda i: i % 2 = 1 AND NOT (
      CASE WHEN len(p) = 1 THEN true
           WHEN i = 1 THEN p[i] = '' OR ends_with(p[i], ',')
           WHEN i = len(p) THEN p[i] = '' OR starts_with(p[i], ',')
           ELSE p[i] = '' OR (starts_with(p[i], ',') AND ends_with(p[i], ',')) END))) = 0 AS closed
  FROM cut
), fields AS (
  SELECT *, string_split(array_to_string(list_transform(range(1, len(p) + 1), lambda i:
      CASE WHEN i % 2 = 0 THEN p[i] WHEN p[i] = '' AND i > 1 AND i < len(p) THEN '"' ELSE replace(p[i], ',', chr(1)) END), ''), chr(1)) AS f
  FROM checked
), judged AS (
  SELECT raw_id, f,
    CASE WHEN record IS NULL THEN 'columns'
         WHEN NOT closed THEN 'quoting'
         WHEN len(f) <> 4 THEN 'columns'
         WHEN NOT regexp_full_match(f[1], '\d{2}/\d{2}/\d{4}') OR try_strptime(f[1], '%d/%m/%Y') IS NULL THEN 'date'
         WHEN NOT regexp_full_match(f[2], '([01]\d|2[0-3]):[0-5]\d') THEN 'time'
         WHEN regexp_full_match(f[3], '[\s\p{Z}\p{Cf}\p{Cc}]*') OR length(f[3]) > 60 OR contains(f[3], ':') THEN 'sender'
         WHEN regexp_full_match(f[4], '[\s\p{Z}\p{Cf}\p{Cc}]*') THEN 'message' END AS reason
  FROM fields
)
"""
ORACLES = {
    "p7_found": _FIELDS + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_loaded": _FIELDS + "SELECT raw_id, f[1] AS date, f[2] AS time, f[3] AS sender, f[4] AS message FROM judged WHERE reason IS NULL",
}
