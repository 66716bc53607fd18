"""Rolling meters, limits, idle sessions and visitor counts over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.adjacent import running_count, with_previous
from chatloom.operators.report import seconds

SLOT = 600


def micros(ts: str):
    return F.expr(f"(unix_date(cast({ts} AS date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS bigint)")


def rolling_usage(events: DataFrame, key: str = "event_type", span: int = 60) -> DataFrame:
    """Events and their summed value of the last `span` seconds of the same key, at each event (both ends included).

    Time is cut into slots; the last seconds of a slot are also sent to the next, so a window holds one slot of one key, not the key.
    Events without time are left out; a null value adds nothing.
    """
    at = events.filter(F.col("ts").isNotNull()).withColumn("at", micros("ts")).withColumn("slot", F.floor(F.col("at") / (SLOT * 1_000_000)))
    late = F.col("at") - F.col("slot") * (SLOT * 1_000_000) >= (SLOT - span) * 1_000_000
    both = at.select(key, "event_id", "at", "value", F.explode(F.when(late, F.array(F.col("slot"), F.col("slot") + 1)).otherwise(F.array("slot"))).alias("slot"))
    frame = Window.partitionBy(key, "slot").orderBy("at").rangeBetween(-span * 1_000_000, 0)
    counted = both.withColumns({"n": F.count("*").over(frame), "total": F.round(F.coalesce(F.sum("value").over(frame), F.lit(0.0)), 4)})
    own = F.floor(F.col("at") / (SLOT * 1_000_000)) == F.col("slot")
    return counted.filter(own).select("event_id", key, "n", "total")


def over_limit(events: DataFrame, minutes: int = 15, limit: int = 3) -> DataFrame:
    """Users and fixed windows of time with more events than allowed."""
    slot = F.floor(seconds("ts") / (minutes * 60))
    n = events.filter(F.col("ts").isNotNull()).groupBy("user_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > limit).withColumn("blocked", F.col("n") - limit)


def idle_sessions(events: DataFrame, idle_minutes: int = 120) -> DataFrame:
    """Sessions of each user that end after so many idle minutes: user_id, session, first and last event, n. Event ids follow time."""
    prev = with_previous(events.filter(F.col("ts").isNotNull() & F.col("user_id").isNotNull()).select("user_id", "event_id", "ts"), "user_id", "event_id", ["ts"])
    gone = (micros("ts") - micros("prev.ts")) >= idle_minutes * 60_000_000
    cut = running_count(prev.withColumn("starts", F.col("prev").isNull() | gone).drop("prev"), "user_id", "event_id", "starts", "session")
    return cut.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


def visitors(events: DataFrame) -> DataFrame:
    """Distinct visitors by day, known by a shortened hash only."""
    hashed = F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 24)
    return events.filter(F.col("ts").isNotNull()).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_distinct(hashed).alias("visitors"), F.count("*").alias("events"))


def property_counts(events: DataFrame) -> DataFrame:
    """Keys and values of the JSON properties: how many events hold them. Broken JSON counts as none."""
    pairs = events.select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return pairs.groupBy("name", "value").agg(F.count("*").alias("n"))


def newest(events: DataFrame, k: int = 500) -> DataFrame:
    """The newest `k` events, as a bounded log keeps them."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(k).select("event_id", "user_id", "event_type", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("user_hash"))


def latest_by_key(events: DataFrame, key: str = "user_id", k: int = 50) -> DataFrame:
    """A memory that moves what comes again to its end: the last event of each key, of these the newest `k`."""
    last = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
    return last.select(key, "e.*").orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def votes(events: DataFrame, middle: float = 50.0) -> DataFrame:
    """How often each kind of event, its name in one form, was valued above the middle and how often not."""
    up = F.coalesce(F.col("value") > middle, F.lit(False))
    return events.groupBy(F.lower(F.trim("event_type")).alias("name")).agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down"))


def since_start(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Events and their summed value of each key, over all time and over the last minute before its newest event."""
    told = events.filter(F.col("ts").isNotNull())
    newest = told.groupBy(key).agg(F.max("ts").alias("newest"))
    recent = (micros("newest") - micros("ts")) <= 60_000_000
    rows = told.join(newest, key)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.count_if(recent).alias("n_minute"))
