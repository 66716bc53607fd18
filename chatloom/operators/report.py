"""The activity report over many chats at once; every function is one lazy DataFrame per section.

Input `m`: one row per message (see `chat_messages`). Counts aggregate in the tasks before they shuffle; whatever needs the
message before goes through operators.adjacent, so no task holds a chat. Of equals what appeared first comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators.adjacent import running_count, with_previous
from chatloom.operators.instants import resolve_instants



def chat_messages(rows: DataFrame) -> DataFrame:
    """One row per message: of stored copies the first loaded; notices and rows without sender left out; null text as empty."""
    kept = rows.filter(~F.coalesce(F.col("is_system"), F.lit(False)) & F.col("sender").isNotNull())
    first = kept.groupBy("chat_id", "msg_id").agg(F.min("row_id").alias("row_id"), F.min_by(F.struct("date", "ts", "sender", "message"), "row_id").alias("_m"))
    return first.select("chat_id", "msg_id", "row_id", "_m.date", "_m.ts", "_m.sender", F.coalesce("_m.message", F.lit("")).alias("message"))


def dated_chat_messages(rows: DataFrame, exports: DataFrame) -> DataFrame:
    """`chat_messages` with `ts` from the minute, in UTC, that any copy's stamp names; `dated_by` tells how.

    `instant` is such a minute; `ts`, where no copy names an instant, the old parser's wall time of the first copy that has one; null neither.
    """
    kept = rows.filter(~F.coalesce(F.col("is_system"), F.lit(False)) & F.col("sender").isNotNull())
    at = resolve_instants(kept.select("chat_id", "msg_id", "row_id", "export_id", "date", "time", "ts"), exports)
    old = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("row_id"))).cast("timestamp_ntz").alias("_old")
    times = at.groupBy(F.col("chat_id").alias("_chat"), F.col("msg_id").alias("_msg")).agg(F.min(F.floor(F.col("utc_second") / 60)).alias("_minute"), old)
    instant = F.expr("cast(make_date(1970, 1, 1) AS timestamp_ntz) + make_dt_interval(0, 0, 0, _minute * 60)")
    m = chat_messages(rows)
    both = m.join(times, m["chat_id"].eqNullSafe(F.col("_chat")) & m["msg_id"].eqNullSafe(F.col("_msg")))
    how = F.when(F.col("_minute").isNotNull(), "instant").when(F.col("_old").isNotNull(), "ts")
    return both.withColumns({"ts": F.coalesce(instant, F.col("_old")), "dated_by": how}).drop("_chat", "_msg", "_minute", "_old")


def coverage(m: DataFrame) -> DataFrame:
    """How many messages of each chat the sections by time count, and how many they leave out for want of a time."""
    n = lambda c, name: F.count_if(c).alias(name)
    return m.groupBy("chat_id").agg(F.count("*").alias("messages"), n(F.col("dated_by") == "instant", "by_instant"), n(F.col("dated_by") == "ts", "by_old_ts"), n(F.col("dated_by").isNull(), "undated"))


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a wall time without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} AS date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60 + cast(second({ts}) AS int)")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key by `order`; keys are few per task since Spark limits before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def overview(m: DataFrame) -> DataFrame:
    low, length = F.lower("message"), ct.utf16_length(F.col("message"))
    media = ["<media omitted>", "image omitted", "video omitted", "audio omitted"]  # fixed values: marks of attachments
    attached = F.col("message").contains("<Media omitted>")
    for x in media[1:]:
        attached = attached | F.col("message").contains(x)
    days = F.floor((F.max(seconds("ts")) - F.min(seconds("ts"))) / 86400.0 + 0.5)
    return m.groupBy("chat_id").agg(
        F.count("*").alias("total_messages"),
        F.count_distinct("sender").alias("participants"),
        F.sum(length).alias("total_characters"),
        F.floor(F.avg(length) + 0.5).alias("average_length"),
        F.sum(F.regexp_count("message", F.lit(ct.LINK))).alias("links"),
        F.count_if(attached).alias("media_messages"),
        F.count_if(low.contains("this message was deleted")).alias("deleted_messages"),
        F.date_format(F.min("ts"), "dd/MM/yyyy").alias("first_date"),
        F.date_format(F.max("ts"), "dd/MM/yyyy").alias("last_date"),
        days.alias("duration_days"),
    )


def participants(m: DataFrame) -> DataFrame:
    """Senders in order of first appearance."""
    seen = m.groupBy("chat_id", "sender").agg(F.min("msg_id").alias("first_msg_id"), F.count("*").alias("messages"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("chat_id").orderBy("first_msg_id")))


def length_by_person(m: DataFrame) -> DataFrame:
    n = ct.utf16_length(F.col("message"))
    return m.groupBy("chat_id", "sender").agg(F.count("*").alias("messages"), F.sum(n).alias("characters"), F.floor(F.avg(n) + 0.5).alias("average_length"), F.max(n).alias("longest"))


def by_date(m: DataFrame) -> DataFrame:
    return m.groupBy("chat_id", "date").agg(F.count("*").alias("messages"))


def by_hour(m: DataFrame) -> DataFrame:
    """All 24 hours of each chat, unused ones with zero."""
    some = m.filter(F.col("ts").isNotNull()).groupBy("chat_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    wide = some.groupBy("chat_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("by_hour"))
    hours = wide.select("chat_id", "by_hour", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.select("chat_id", "hour", F.coalesce(F.try_element_at("by_hour", "hour"), F.lit(0)).alias("messages"))


def by_weekday(m: DataFrame) -> DataFrame:
    return m.filter(F.col("ts").isNotNull()).groupBy("chat_id", F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("messages"))


def by_month(m: DataFrame) -> DataFrame:
    """Messages by month with the share of the busiest month in per cent."""
    months = m.filter(F.col("ts").isNotNull()).groupBy("chat_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("messages"))
    most = F.max("messages").over(Window.partitionBy("chat_id"))
    return months.withColumn("percent_of_busiest", F.floor(100.0 * F.col("messages") / most + 0.5))


def longest_message(m: DataFrame) -> DataFrame:
    n = ct.utf16_length(F.col("message"))
    best = m.groupBy("chat_id").agg(F.max(F.struct(n.alias("length"), (-F.col("msg_id")).alias("at"), "sender")).alias("b"))
    return best.select("chat_id", (-F.col("b.at")).alias("msg_id"), "b.sender", "b.length")


def _counted(m: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    long = m.select(*keys, "msg_id", F.posexplode(items).alias("pos", name))
    return long.groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(F.struct("msg_id", "pos")).alias("first"))


def top_emojis(m: DataFrame, k: int = 10) -> DataFrame:
    found = _counted(m, ["chat_id"], ct.emojis(F.col("message")), "emoji")
    return top(found, ["chat_id"], [F.desc("n"), F.col("first")], k).select("chat_id", "rank", "emoji", "n")


def emojis_per_person(m: DataFrame) -> DataFrame:
    return m.groupBy("chat_id", "sender").agg(F.sum(F.size(ct.emojis(F.col("message")))).alias("emojis")).filter("emojis > 0")


def _word_order(keys: list[str]) -> list[Column]:
    number = F.when(F.col("word").rlike("^(0|[1-9][0-9]{0,9})$"), F.col("word").try_cast("bigint"))
    return [F.desc("n"), number.asc_nulls_last(), F.col("first")]


def top_words(m: DataFrame, k: int = 20) -> DataFrame:
    found = _counted(m, ["chat_id"], ct.words(F.col("message")), "word")
    # the total is joined: as a window over the vocabulary of a chat it would keep Spark from limiting before it shuffles
    total = found.groupBy("chat_id").agg(F.sum("n").alias("total_words"))
    ranked = top(found, ["chat_id"], _word_order(["chat_id"]), k).join(total, "chat_id")
    return ranked.select("chat_id", "rank", "word", "n", "total_words")


def word_cloud(m: DataFrame, k: int = 24) -> DataFrame:
    """The first `k` words with their size against the most frequent one."""
    found = top_words(m, k)
    return found.select("chat_id", "rank", "word", F.round(F.col("n") / F.max("n").over(Window.partitionBy("chat_id")), 6).alias("scale"))


def words_by_person(m: DataFrame, k: int = 10) -> DataFrame:
    found = _counted(m, ["chat_id", "sender"], ct.words(F.col("message")), "word")
    ranked = top(found, ["chat_id", "sender"], _word_order([]), k).groupBy("chat_id", "sender").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("words"))
    # who said no word that counts has an empty list
    everyone = m.select("chat_id", "sender").distinct().join(ranked, ["chat_id", "sender"], "left")
    return everyone.select("chat_id", "sender", F.explode_outer("words").alias("w")).select("chat_id", "sender", "w.rank", "w.word", "w.n")


def replies(m: DataFrame) -> DataFrame:
    """Each message with the one before: `gap_minutes`, null without both times; `starts` a conversation at 120 minutes or more, or first of all."""
    prev = with_previous(m, "chat_id", "msg_id", ["msg_id", "sender", "ts"])
    gap = (seconds("ts") - seconds("prev.ts")) / 60.0
    starts = F.col("prev").isNull() | F.coalesce(gap >= 120, F.lit(False))
    return prev.select("chat_id", "msg_id", "sender", "ts", "message", F.col("prev.sender").alias("prev_sender"), F.col("prev.msg_id").alias("prev_msg_id"), gap.alias("gap_minutes"), starts.alias("starts"))


def conversation_starters(m: DataFrame) -> DataFrame:
    n = replies(m).filter("starts").groupBy("chat_id", "sender").agg(F.count("*").alias("starts"))
    total = F.sum("starts").over(Window.partitionBy("chat_id"))
    return n.withColumn("total", total).withColumn("percentage", F.floor(100.0 * F.col("starts") / F.col("total") + 0.5))


def numbered_conversations(m: DataFrame) -> DataFrame:
    """The running number of the conversation of each message."""
    return running_count(replies(m).select("chat_id", "msg_id", "sender", "starts"), "chat_id", "msg_id", "starts", "conversation")


def _responses(m: DataFrame, most: int = 1440) -> DataFrame:
    return replies(m).filter((F.col("sender") != F.col("prev_sender")) & F.col("gap_minutes").between(0, most))


def response_stats(m: DataFrame) -> DataFrame:
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10.0
    return _responses(m).groupBy("chat_id", "sender").agg(
        F.count("*").alias("responses"), tenth(F.avg("gap_minutes")).alias("average_minutes"), tenth(F.min("gap_minutes")).alias("fastest_minutes"), tenth(F.median("gap_minutes")).alias("median_minutes")
    )


def fastest_response(m: DataFrame) -> DataFrame:
    best = _responses(m).groupBy("chat_id").agg(F.min(F.struct("gap_minutes", "msg_id", "sender", "prev_sender", "prev_msg_id")).alias("b"))
    return best.select("chat_id", F.col("b.sender").alias("responder"), "b.gap_minutes", "b.msg_id", "b.prev_sender", "b.prev_msg_id")


def reply_pairs(m: DataFrame, k: int = 10) -> DataFrame:
    n = _responses(m, 120).groupBy("chat_id", "prev_sender", "sender").agg(F.count("*").alias("replies"), F.min("msg_id").alias("first"))
    return top(n, ["chat_id"], [F.desc("replies"), F.col("first")], k).select("chat_id", "rank", F.col("prev_sender").alias("from_sender"), F.col("sender").alias("to_sender"), "replies")


def night_share(m: DataFrame) -> DataFrame:
    """Messages from 22:00 to 04:59 in per cent, and the busiest hour (the earliest of equals)."""
    hours = m.filter(F.col("ts").isNotNull()).groupBy("chat_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    night = F.sum(F.when((F.col("hour") >= 22) | (F.col("hour") < 5), F.col("n")).otherwise(0))
    return hours.groupBy("chat_id").agg(F.floor(100.0 * night / F.sum("n") + 0.5).alias("night_percent"), F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"))


def streaks(m: DataFrame) -> DataFrame:
    """The longest run of days with messages, the earliest of equals."""
    days = m.filter(F.col("ts").isNotNull()).select("chat_id", F.col("ts").cast("date").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("chat_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("chat_id", "island").agg(F.count("*").cast("int").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return top(runs, ["chat_id"], [F.desc("days"), F.col("first_day")], 1).select("chat_id", "days", "first_day", "last_day")


def biggest_day(m: DataFrame) -> DataFrame:
    days = m.filter(F.col("ts").isNotNull()).groupBy("chat_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("messages"), F.min("msg_id").alias("first"))
    return top(days, ["chat_id"], [F.desc("messages"), F.col("first")], 1).select("chat_id", "day", "messages")


def most_talkative(m: DataFrame) -> DataFrame:
    n = participants(m).withColumn("total", F.sum("messages").over(Window.partitionBy("chat_id")))
    best = top(n, ["chat_id"], [F.desc("messages"), F.col("first_msg_id")], 1)
    return best.select("chat_id", "sender", "messages", F.floor(100.0 * F.col("messages") / F.col("total") + 0.5).alias("percent"))


def vibe(m: DataFrame) -> DataFrame:
    """Score of chats of two: the mean of message balance, starter balance and reply rhythm, where two of them can be told."""
    n = m.groupBy("chat_id", "sender").agg(F.count("*").alias("n"))
    started = replies(m).filter("starts").groupBy("chat_id", "sender").agg(F.count("*").alias("s"))
    answered = response_stats(m).select("chat_id", "sender", F.col("average_minutes").alias("r"))
    both = n.join(started, ["chat_id", "sender"], "left").join(answered, ["chat_id", "sender"], "left")
    pair = both.groupBy("chat_id").agg(
        F.count("*").alias("people"), F.max("n").alias("n1"), F.sum("n").alias("n2"), F.max(F.coalesce("s", F.lit(0))).alias("s1"), F.sum("s").alias("s2"),
        F.count("r").alias("rn"), F.min("r").alias("r1"), F.max("r").alias("r2"),
    ).filter("people = 2")
    half = lambda a, b: F.greatest(F.lit(0.0), F.floor(100 - 2 * F.abs(100.0 * F.col(a) / F.col(b) - 50) + 0.5))
    rhythm = F.when((F.col("rn") == 2) & (F.col("r2") > 0), F.floor(100.0 * F.col("r1") / F.col("r2") + 0.5))
    parts = F.filter(F.array(half("n1", "n2").cast("double"), F.when(F.col("s2") > 0, half("s1", "s2")).cast("double"), rhythm.cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)
    return pair.filter(F.size(parts) >= 2).select("chat_id", F.floor(mean + 0.5).cast("bigint").alias("score"))


def aliases(m: DataFrame) -> DataFrame:
    """Senders under letters, in alphabetical order of each chat; after the 26th by number."""
    people = m.select("chat_id", "sender").distinct()
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("sender"))
    named = people.withColumn("n", n)
    alias = F.concat(F.lit("Person "), F.when(F.col("n") <= 26, F.char(64 + F.col("n"))).otherwise(F.col("n").cast("string")))
    return named.select("chat_id", "sender", alias.alias("alias"))


def collapse_floods(m: DataFrame, most: int = 3) -> DataFrame:
    """At most `most` messages of each run of one sender."""
    prev = with_previous(m.select("chat_id", "msg_id", "sender"), "chat_id", "msg_id", ["sender"])
    cut = prev.withColumn("changed", ~F.coalesce(F.col("prev.sender") == F.col("sender"), F.lit(False)))
    runs = running_count(cut.drop("prev"), "chat_id", "msg_id", "changed", "run")
    # a run may be long: only its first few are kept, and Spark drops the rest before it shuffles
    return top(runs, ["chat_id", "run"], [F.col("msg_id")], most, "in_run").select("chat_id", "msg_id", "sender", "in_run")


def page(m: DataFrame, number: int = 2, size: int = 50, sender: str | None = None, text: str | None = None) -> DataFrame:
    """A page of the messages of all chats in order: sender and literal text compared without case; page and size clamped."""
    if sender is not None:
        m = m.filter(F.lower("sender") == sender.lower())
    if text is not None:
        m = m.filter(F.contains(F.lower("message"), F.lit(text.lower())))
    size = min(max(size, 10), 100)
    return m.orderBy("chat_id", "msg_id").offset((max(number, 1) - 1) * size).limit(size).select("chat_id", "msg_id", "date", "sender", F.substring("message", 1, 200).alias("text"))


def browse(m: DataFrame, number: int = 1, size: int = 50, sender: str | None = None, text: str | None = None) -> DataFrame:
    """A page as `page` chooses it, with whole messages; a page past the end is the last one. `total`, `page` and `total_pages` stand on each row."""
    if sender is not None:
        m = m.filter(F.lower("sender") == sender.lower())
    if text is not None:
        m = m.filter(F.contains(F.lower("message"), F.lit(text.lower())))
    size = min(max(size, 10), 100)
    total = m.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    rows = m.orderBy("chat_id", "msg_id").offset((number - 1) * size).limit(size)
    return rows.select("chat_id", "msg_id", "date", "sender", "message", *[F.lit(v).cast("bigint").alias(c) for c, v in (("total", total), ("page", number), ("total_pages", pages))])


def persona(m: DataFrame) -> DataFrame:
    """A chat in a row: messages, peak hour, night share, most used emojis and words in order, fastest mean reply, messages of the busiest day."""
    listed = lambda df, name, k: df.filter(F.col("rank") <= k).groupBy("chat_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias(f"{name}s"))
    replies_of = response_stats(m).filter("average_minutes > 0").groupBy("chat_id").agg(F.min("average_minutes").alias("fastest_average"))
    parts = [night_share(m), listed(top_emojis(m), "emoji", 5), listed(top_words(m), "word", 8), replies_of, biggest_day(m).select("chat_id", F.col("messages").alias("busiest_day"))]
    out = m.groupBy("chat_id").agg(F.count("*").alias("total_messages"))
    for p in parts:
        out = out.join(p, "chat_id", "left")
    return out


def highlights(m: DataFrame) -> DataFrame:
    """Statements that a chat is strong enough for, as rows of chat_id, statement, value; they never hold a name."""
    totals = m.groupBy("chat_id").agg(F.count("*").alias("n"))
    gates = [
        ("night_owls", night_share(m).join(totals, "chat_id").filter("n >= 100 AND night_percent >= 20"), "night_percent"),
        ("streak", streaks(m).filter("days >= 7"), "days"),
        ("big_day", biggest_day(m).filter("messages >= 50"), "messages"),
        ("quick_reply", fastest_response(m).withColumn("s", F.floor(F.col("gap_minutes") * 60 + 0.5)).filter("s BETWEEN 1 AND 300"), "s"),
        ("emoji", top_emojis(m, 1).filter("n >= 50"), "n"),
        ("words", top_words(m, 1).filter("total_words >= 1000"), "total_words"),
        ("span", overview(m).filter("duration_days >= 30"), "duration_days"),
    ]
    rows = [df.select("chat_id", F.lit(name).alias("statement"), F.col(value).cast("bigint").alias("value")) for name, df, value in gates]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def month_rhythm(m: DataFrame, last: int = 12) -> DataFrame:
    """The `last` months with messages of each chat, in per cent of the busiest of them."""
    months = by_month(m).select("chat_id", "month", "messages")
    kept = top(months, ["chat_id"], [F.desc("month")], last, "back")
    most = F.max("messages").over(Window.partitionBy("chat_id"))
    return kept.select("chat_id", "month", "messages", F.floor(100.0 * F.col("messages") / most + 0.5).alias("percent"))


def records(m: DataFrame) -> DataFrame:
    """Superlatives of a chat as rows of chat_id, record, holder, value: most active weekday and busiest month (what occurred first of equals), who replies fastest on the mean."""
    told = m.filter(F.col("ts").isNotNull())
    of = lambda name, key: top(told.groupBy("chat_id", key.alias("holder")).agg(F.count("*").alias("n"), F.min("msg_id").alias("first")), ["chat_id"], [F.desc("n"), F.col("first")], 1).select("chat_id", F.lit(name).alias("record"), "holder", F.col("n").cast("double").alias("value"))
    fastest = top(response_stats(m), ["chat_id"], [F.col("average_minutes"), F.col("sender")], 1).select("chat_id", F.lit("fastest_responder").alias("record"), F.col("sender").alias("holder"), F.col("average_minutes").alias("value"))
    return of("weekday", F.date_format("ts", "EEEE")).unionByName(of("month", F.date_format("ts", "yyyy-MM"))).unionByName(fastest)


def minutes_text(col: Column) -> Column:
    """Minutes as people say them: seconds under one, hours and minutes from sixty on; N/A for null."""
    whole = lambda c: F.floor(c + 0.5).cast("bigint").cast("string")
    rest = F.floor(col % 60 + 0.5)
    hours = F.concat(F.floor(col / 60).cast("bigint").cast("string"), F.lit(" hr"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("bigint").cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(col.isNull(), "N/A").when(col < 1, F.concat(whole(col * 60), F.lit(" sec"))).when(col < 60, F.concat(whole(col), F.lit(" min"))).otherwise(hours)


def tiles(m: DataFrame) -> DataFrame:
    """What a card about a chat shows, as rows of chat_id, tile, value, sub; a tile without data is absent. Names are first names."""
    first_name = lambda c: F.split(F.trim(c), r"\s+")[0]
    none = F.lit(None).cast("string")
    row = lambda df, tile, value, sub=none: df.select("chat_id", F.lit(tile).alias("tile"), value.cast("string").alias("value"), sub.alias("sub"))
    view = overview(m).join(most_talkative(m).select("chat_id", "sender"), "chat_id")
    fastest = top(response_stats(m).filter("average_minutes > 0"), ["chat_id"], [F.col("average_minutes"), F.col("sender")], 1)
    starter = top(conversation_starters(m), ["chat_id"], [F.desc("starts"), F.col("sender")], 1)
    parts = [
        row(view, "people", F.col("participants"), F.concat(F.lit("most messages: "), first_name(F.col("sender")))),
        row(view.filter("duration_days > 0"), "days", F.format_number("duration_days", 0), F.concat_ws(" to ", "first_date", "last_date")),
        row(night_share(m), "peak_hour", F.concat_ws(" to ", F.col("peak_hour").cast("string"), (F.col("peak_hour") + 1).cast("string"))),
        row(fastest, "fastest_reply", first_name(F.col("sender")), minutes_text(F.col("average_minutes"))),
        row(top_emojis(m, 1), "emoji", F.col("emoji"), F.concat(F.format_number("n", 0), F.lit(" times"))),
        row(starter, "starter", first_name(F.col("sender")), F.concat(F.lit("starts "), F.col("percentage").cast("string"), F.lit("% of conversations"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aliased(m: DataFrame) -> DataFrame:
    """Messages with aliases for senders, so that every section over them names nobody."""
    return m.join(aliases(m), ["chat_id", "sender"]).drop("sender").withColumnRenamed("alias", "sender")
