"""Questions that the report answers: an ordered router from patterns to sections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import report

# What a question says, in English or Hinglish, for each section that answers it; in order of precedence.
ASKS = {
    "longer_messages": r"(?:who|kaun).*(?:long|lambi|lmba).*message|longer messages|message length|verbose",
    "who_talks_most": r"(?:who|kaun|kis).*(?:talk|message|text|speak|baat|msg)|zyada (?:baat|message|msg)|(?:most|sabse zyada) (?:messages?|msgs?|texts?)",
    "total": r"how many (?:total )?messages|(?:kitne|total) message",
    "participants": r"who (?:are|is) (?:the )?participants?|how many participants|participants in",
    "reply_speed": r"(?:who|kaun).*(?:repl|respond|jaldi)|repl(?:y|ies) faster|responds? faster|response time",
    "starters": r"(?:who|kaun).*(?:start|begin|shuru|pehle)|conversation starter",
    "emoji_user": r"(?:who|kaun).*(?:emoji|smiley)|more emojis?",
    "busiest_day": r"(?:busiest|most active|sabse active) (?:day|weekday)",
    "busiest_hour": r"(?:busiest|most active|sabse active) (?:hour|time)",
    "top_emoji": r"most (?:used|common) emoji|top emoji",
}
SECTIONS = {
    "longer_messages": lambda m: report.top(report.length_by_person(m), ["chat_id"], [F.desc("average_length"), F.col("sender")], 1).drop("rank"),
    "who_talks_most": report.most_talkative,
    "total": lambda m: report.overview(m).select("chat_id", "total_messages"),
    "participants": report.participants,
    "reply_speed": lambda m: report.top(report.response_stats(m), ["chat_id"], [F.col("average_minutes"), F.col("sender")], 1).select("chat_id", "sender", report.minutes_text(F.col("average_minutes")).alias("average")),
    "starters": lambda m: report.top(report.conversation_starters(m), ["chat_id"], [F.desc("starts"), F.col("sender")], 1).drop("rank"),
    "emoji_user": lambda m: report.top(report.emojis_per_person(m), ["chat_id"], [F.desc("emojis"), F.col("sender")], 1).drop("rank"),
    "busiest_day": lambda m: report.records(m).filter("record = 'weekday'").drop("record"),
    "busiest_hour": lambda m: report.night_share(m).select("chat_id", "peak_hour"),
    "top_emoji": lambda m: report.top_emojis(m, 1).drop("rank"),
}


def route(question: str) -> str | None:
    """The first section whose pattern the question fits, None if the report doesn't answer it."""
    return next((name for name, pattern in ASKS.items() if re.search(pattern, question.lower())), None)


def answer(m: DataFrame, question: str) -> DataFrame | None:
    """The section that answers a question for every chat, or None."""
    name = route(question)
    return SECTIONS[name](m) if name else None
