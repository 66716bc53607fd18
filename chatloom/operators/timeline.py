"""Stored message rows as dated messages: the shared input of sessions and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.textform import normal_key
from chatloom.operators.instants import resolve_instants

#: Nothing that can be seen: white space, separators, format and control characters only.
_BLANK = r"\s\p{Z}\p{Cf}\p{Cc}\x{FE0E}\x{FE0F}\x{3164}\x{115F}\x{1160}"
UNSEEN = f"^[{_BLANK}]*$"
#: Anything else; most texts begin with it, so the search ends at once.
SEEN = f"[^{_BLANK}]"


def has_visible_text(message: Column, *flags: Column) -> Column:
    """True for text that can be read: not null, not blank, none of the flags (null counts as unset)."""
    shown = message.isNotNull() & message.rlike(SEEN)
    for f in flags:
        shown = shown & ~F.coalesce(f, F.lit(False))
    return shown


def dated_rows(messages: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per stored row: chat_id, msg_id, minute, person, visible, system, loaded_at.

    `minute` is the instant in whole minutes since 1970 UTC, null without an instant; `person` the sender in its
    one form, null for a null sender. Rows without chat_id or msg_id name no message and are left out.
    """
    slim = messages.select(
        "chat_id", "msg_id", "export_id", "date", "time", "sender", "loaded_at",
        has_visible_text(F.col("message"), F.col("is_media"), F.col("is_deleted")).alias("visible"),
        F.coalesce(F.col("is_system"), F.lit(False)).alias("system"),
    ).filter(F.col("chat_id").isNotNull() & F.col("msg_id").isNotNull())
    at = resolve_instants(slim, exports)
    return at.select(
        "chat_id", "msg_id", F.floor(F.col("utc_second") / 60).alias("minute"), normal_key(F.col("sender")).alias("person"), "visible", "system", "loaded_at"
    )


def dated_messages(rows: DataFrame) -> DataFrame:
    """One row per message that isn't a notice; copies count once and give each other what one lacks."""
    one = rows.groupBy("chat_id", "msg_id").agg(
        F.min("minute").alias("minute"), F.min("person").alias("person"), F.max("visible").alias("visible"), F.max("system").alias("system")
    )
    return one.filter(~F.col("system")).drop("system")
