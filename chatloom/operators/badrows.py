"""Rows that fail to parse: a strict load, and the rest with the reason.

Method: strict load plus anti-join. Raw records keep their offsets; only conforming rows load; the loaded offsets
are subtracted from the raw ones and only the remainder is diagnosed. All expressions are native; quotes are
read by cutting a record at its quote characters, so even very long records need no backtracking pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.timeline import UNSEEN
from chatloom.session import set_aside

_CUT, _ESC = "\x01b", "\x01a"  # a field cut, and the escape of the mark itself


def csv_parts(record: Column) -> Column:
    """The record cut at quote characters: parts at even index stand outside quotes."""
    return F.split(record, '"')


def quoting_ok(parts: Column) -> Column:
    """Every quoted field is closed and ends its field, and no quote stands in an unquoted field."""
    n = F.size(parts)

    def outside(part: Column, i: Column) -> Column:
        first, last = i == 0, i == n - 1
        joins = part.startswith(",") & part.endswith(",")
        return F.when(first & last, True).when(first, (part == "") | part.endswith(",")).when(last, (part == "") | part.startswith(",")).otherwise((part == "") | joins)

    flagged = F.transform(parts, lambda part, i: (i % 2 == 1) | outside(part, i))
    return (n % 2 == 1) & F.forall(flagged, lambda ok: ok)


def csv_fields(parts: Column) -> Column:
    """The fields of a record whose quoting is right, without the outer quotes, a doubled quote as one."""
    n = F.size(parts)

    def written(part: Column, i: Column) -> Column:
        safe = F.replace(part, F.lit("\x01"), F.lit(_ESC))
        doubled = (part == "") & (i > 0) & (i < n - 1)
        return F.when(i % 2 == 1, safe).when(doubled, F.lit('"')).otherwise(F.replace(safe, F.lit(","), F.lit(_CUT)))

    whole = F.array_join(F.transform(parts, written), "")
    return F.transform(F.split(whole, _CUT), lambda f: F.replace(f, F.lit(_ESC), F.lit("\x01")))


def first_bad_field(fields: Column) -> Column:
    """Name of the first bad field of four, null where all are good."""
    date, time, sender, message = (fields[i] for i in range(4))
    day = F.when(date.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(date, "dd/MM/yyyy"))
    real = day.isNotNull() & (F.date_format(day, "dd/MM/yyyy") == date)
    good_sender = ~sender.rlike(UNSEEN) & (F.char_length(sender) <= 60) & ~sender.contains(":")
    return (
        F.when(~F.coalesce(real, F.lit(False)), "date").when(~time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "time")
        .when(~good_sender, "sender").when(message.rlike(UNSEEN), "message")
    )


def strict_load(raw: DataFrame, offset: str = "raw_id", record: str = "record") -> DataFrame:
    """Conforming rows only: the offset, `record_hash`, date, time, sender, message. A null record doesn't conform."""
    parts = csv_parts(F.col(record))
    closed = raw.select(offset, F.xxhash64(record).alias("record_hash"), parts.alias("_parts")).filter(quoting_ok(F.col("_parts")))
    four = closed.withColumn("_f", csv_fields(F.col("_parts"))).filter(F.size("_f") == 4)
    good = four.filter(first_bad_field(F.col("_f")).isNull())
    return good.select(offset, "record_hash", *[F.col("_f")[i].alias(c) for i, c in enumerate(("date", "time", "sender", "message"))])


def failed_records(raw: DataFrame, offset: str = "raw_id", record: str = "record") -> DataFrame:
    """The rest of `raw` after the strict load, all its columns with `reason`.

    Reason: `quoting`, else `columns` (a null record has none), else the first bad field. Repeated records each come out; an offset given
    twice is told apart by its record, null offsets too.
    """
    raw, back = set_aside(raw)
    loaded = strict_load(raw, offset, record).select(F.col(offset).alias("_offset"), F.col("record_hash").alias("_hash"))
    rest = raw.join(loaded, F.col(offset).eqNullSafe(F.col("_offset")) & (F.xxhash64(record) == F.col("_hash")), "left_anti")
    parts = csv_parts(F.col(record))
    fields = F.when(quoting_ok(parts), csv_fields(parts))
    seen = rest.withColumn("_f", fields)
    reason = F.when(F.col(record).isNull(), "columns").when(F.col("_f").isNull(), "quoting").when(F.size("_f") != 4, "columns").otherwise(first_bad_field(F.col("_f")))
    return seen.withColumn("reason", reason).drop("_f").withColumnsRenamed(back)
