"""Text exports of chats as a source: files of lines become typed messages.

Files of any size are read as lines by splits; lines are joined to messages by gaps and islands over blocks of lines, so no task
needs a whole file or a whole chat in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.functions.stamps import whole as whole_number
from chatloom.operators.adjacent import running_count
from chatloom.session import materialize, settled

#: White space as the exports' writers count it.
BLANKS = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A line is cut into its stamp and the rest; the stamp is then read part by part. A stamp begins a line, within brackets or not, and is a day, a clock and perhaps a half of the day.
STAMP = r"^\[?(?<day>[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})(?<gap>,\s*|\s+)(?<clock>[0-9]{1,2}(?::[0-9]{2}){1,2})\s*(?<half>[aApP]\.?[mM]\.?)?\]?\s*(?<rest>.*)$"
DAY, GAP, CLOCK, HALF, REST = 1, 2, 3, 4, 5
#: A sender: up to sixty characters before the first colon.
SENDER_LENGTH = 60
# What the app writes in place of an attachment or a deleted message.
MEDIA = r"(?i)<media omitted>|(?:image|video|audio|sticker|document|gif) omitted"
DELETED = r"(?i)this message was deleted|you deleted this message"


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file below `path`: file, value, and the columns of its folders. A file is a row of one task here; `read_lines` has no such bound."""
    return spark.read.text(path, wholetext=True).select("*", F.col("_metadata.file_path").alias("file"))


def refused_files(spark: SparkSession, path: str, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """The files below `path` that an upload would refuse, with the reason: not a text file, or larger than `most_bytes`. Nothing else is read of them; Spark passes over empty files itself."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    reason = F.when(~F.lower("file").endswith(".txt"), "not a text file").when(F.col("bytes") > most_bytes, "too large")
    return files.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files below `path`, whatever their size: file, line_no from 0, raw.

    A split gives its lines in order; its number in the file follows from the lines of the splits before it. The numbered
    lines are written once, since line numbers and their counts must come from one reading.
    """
    read = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("raw")
    )
    read = materialize(read, "lines")
    splits = read.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("file", "split", (earlier - F.col("first")).alias("shift"))
    return read.join(begins, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "raw")


def parse_exports(files: DataFrame) -> DataFrame:
    """Messages of files (file, value): file, id from 0, date DD/MM/YYYY, time HH:MM, ts (null where it can't be), sender, message, links, emojis, flags.

    A line with stamp and sender opens a message, a line with a stamp only is a notice and closes it, other lines that aren't blank go on with the open message,
    trimmed. Lines before the first stamp and after a notice are dropped, as are messages without text. Empty and foreign files give no rows.
    """
    return parse_lines(files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "raw")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Messages of numbered lines (file, line_no, raw), as `parse_exports`."""
    lines = lines.withColumn("line", F.translate("raw", "\u202f\u00a0\u200e\u200f", "    ")).drop("raw")
    part = lambda i: F.regexp_extract("line", STAMP, i)
    cut = settled(lines, {"stamped": F.col("line").rlike(STAMP), "day": part(DAY), "gap": part(GAP), "clock": part(CLOCK), "half": part(HALF), "rest": part(REST)})
    numbers = F.split("day", "[-/.]")
    iso = F.col("day").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    local = F.col("day").rlike("^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$") & F.col("gap").startswith(",")
    body = F.regexp_replace("rest", r"^[-\x{2013}\x{2014}]?\s*", "")
    cut = settled(cut.withColumn("body", body), {"form": F.when(F.col("stamped") & iso, "iso").when(F.col("stamped") & local, "day"), "colon": F.instr("body", ":")})
    talks = F.col("form").isNotNull() & F.col("colon").between(2, SENDER_LENGTH + 1)
    notice = F.col("form").isNotNull() & ~talks & (F.col("body") != "") & ~F.col("body").startswith(":")
    marked = cut.withColumn("kind", F.when(talks, F.col("form")).when(notice, "notice")).withColumn("opens", F.col("kind").isNotNull())
    marked = running_count(marked, "file", "line_no", "opens", "island")
    spoken = F.substring("body", F.col("colon") + 1, F.char_length("body"))
    text = F.when(F.col("opens"), F.regexp_replace(spoken, r"^\s+", "")).otherwise(trimmed(F.col("line")))
    clock = F.split("clock", ":")
    of_head = {"g1": numbers[0], "g2": numbers[1], "g3": numbers[2], "g4": clock[0], "g5": clock[1], "g6": F.col("half"), "g7": F.substring("body", F.lit(1), F.col("colon") - 1)}
    heads = marked.filter(F.col("island") > 0).select("file", "island", "line_no", "kind", "opens", text.alias("text"), *[F.when(F.col("opens") & (F.col("kind") != "notice"), v).alias(k) for k, v in of_head.items()])
    kept = heads.filter(F.col("opens") | (F.col("text") != ""))
    whole = kept.groupBy("file", "island").agg(
        F.min("line_no").alias("line_no"),
        F.max("kind").alias("kind"),
        *[F.max(f"g{i}").alias(f"g{i}") for i in range(1, 8)],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("message"),
    )
    said = whole.filter(F.col("kind") != "notice").withColumn("message", trimmed(F.col("message"))).filter("message <> ''")
    n = lambda i: whole_number(F.col(f"g{i}"))
    first, second, third = n(1), n(2), n(3)
    iso = F.col("kind") == "iso"
    year = F.when(iso, first).otherwise(F.when(third < 100, third + 2000).otherwise(third))
    swapped = ~iso & (second > 12) & (first <= 12)
    month = F.when(swapped, first).otherwise(second)
    date_day = F.when(iso, third).when(swapped, second).otherwise(first)
    half = F.lower(F.regexp_replace("g6", r"\.", ""))
    hour = F.when((half == "pm") & (n(4) != 12), n(4) + 12).when((half == "am") & (n(4) == 12), 0).otherwise(n(4))
    dated = said.withColumns({"_y": year, "_m": month, "_d": date_day, "_h": hour, "_mi": n(5), "sender": trimmed(F.col("g7"))}).withColumn("one", F.lit(True))
    numbered = running_count(dated, "file", "line_no", "one", "nth")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    # a day over the month's end rolls into the next month
    ts = F.expr("cast(add_months(make_date(_y, 1, 1), _m - 1) AS timestamp_ntz) + make_dt_interval(_d - 1, _h, _mi, 0)")
    return numbered.select(
        "file", (F.col("nth") - 1).alias("id"), F.concat_ws("/", two("_d"), two("_m"), F.lpad(F.col("_y").cast("string"), 4, "0")).alias("date"), F.concat_ws(":", two("_h"), two("_mi")).alias("time"),
        F.when(F.col("_m").between(1, 12) & (F.col("_y") >= 1), ts).alias("ts"), "sender", "message", F.regexp_extract_all("message", F.lit(ct.LINK), F.lit(0)).alias("links"),
        ct.emojis(F.col("message")).alias("emojis"), ct.utf16_length(F.col("message")).alias("message_length"), F.col("message").rlike(MEDIA).alias("is_media"), F.col("message").rlike(DELETED).alias("is_deleted"),
    )


def write_exports(messages: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Messages (chat_id, msg_id, ts, sender, message) as text exports, one folder per chat and run of numbers.

    Only rows that such a line can hold: with time and sender, the sender without colon and line break and up to 60 characters.
    """
    fits = F.col("ts").isNotNull() & F.col("sender").rlike(r"^[^:\n\r]{1,60}$") & (trimmed(F.col("sender")) != "")
    line = F.concat(F.date_format("ts", "dd/MM/yyyy, HH:mm"), F.lit(" - "), F.col("sender"), F.lit(": "), F.col("message"))
    rows = messages.filter(fits).select("chat_id", F.floor(F.col("msg_id") / per_file).alias("part"), "msg_id", line.alias("value"))
    spread = rows.repartition("chat_id", "part").sortWithinPartitions("chat_id", "part", "msg_id")
    spread.select("value", "chat_id", "part").write.partitionBy("chat_id", "part").text(path)
